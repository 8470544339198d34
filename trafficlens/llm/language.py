"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary. The probability of a word is the sum
over all ways to cut it into pieces, computed by the forward algorithm; a text's score for a language is the sum of
its words' logarithms plus the language's share. Piece probabilities are learned by expectation maximisation over
word counts: expected piece counts come from the forward and backward sums of every distinct word.

Only runs of letters count, in lower case with a word-start mark; a run of more than 32 letters is taken in parts of
32. Pieces of more than ``LONGEST_PIECE`` letters are not used (the default vocabulary has none). A letter outside the
vocabulary is one unknown piece. Word counts are summed inside tasks before they are
shuffled, and are those of all training documents; what reaches the driver is one number per piece and language.

Defined results: a null text or one without letters is ``und`` with score 0; rows with a null language teach nothing;
with no training rows every text is ``und``; ties go to the language first by name; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import saved, with_made
from trafficlens.llm.worker_memory import held, tidy

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
LONGEST_WORD = 32
LONGEST_PIECE = 16
COUNTER_LIMIT = 300_000
CACHE_LIMIT = 200_000
STEP_ROWS = 50_000
SLICE_CHARS = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> Pieces:
    """This process's pieces of a vocabulary file."""
    return held("pieces", path, load_pieces)


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return Pieces(p for p in found if len(p) <= LONGEST_PIECE and p == p.lower() and all(c.isalpha() for c in p.removeprefix(START)))


def hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Polynomial hashes of all runs of 1, 2, ... codes, by start and word."""
    h = np.zeros(codes.shape, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(min(len(codes), LONGEST_PIECE)):
            h = h[: len(codes) - n] * BASE + codes[n:]
            yield h


@dataclass
class Matches:
    """Where pieces stand in words of one length: (start, end, which words, numbers of the pieces), by start."""

    words: int
    length: int
    hits: list[tuple[int, int, slice | np.ndarray, np.ndarray]]


class Pieces:
    """The pieces with a hash table from a run of letters to its piece. Numbers: unknown 0, pieces from 1."""

    BITS = 20

    def __init__(self, pieces):
        self.names = ["<unk>", *sorted(set(pieces) | {START})]
        self.size = len(self.names)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        keys = np.array([self.key(p) for p in self.names[1:]], dtype=np.uint64)
        ids = np.arange(1, self.size)
        while len(keys):  # keys that share a slot go on to the next table
            slots, first = np.unique(self.slot(keys), return_index=True)
            key_at, id_at = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            key_at[slots], id_at[slots] = keys[first], ids[first]
            self.tables.append((key_at, id_at))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ids = keys[rest], ids[rest]
        self.taken = self.tables[0][1] >= 0  # a key of a later table shares its slot with one of the first

    @staticmethod
    def key(piece: str) -> int:
        *_, last = hashes(np.array([[ord(c)] for c in piece], dtype=np.uint64))
        return int(last[0, 0])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are pieces, and their numbers. Most runs of letters end at a slot that is not taken."""
        at = self.slot(keys)
        maybe = np.flatnonzero(self.taken[at])
        keys, at, out = keys[maybe], at[maybe], np.full(len(maybe), -1, np.int32)
        for key_at, id_at in self.tables:
            np.copyto(out, id_at[at], where=key_at[at] == keys)
        hit = out >= 0
        return maybe[hit], out[hit]

    def matches(self, codes: np.ndarray) -> Matches:
        """The pieces in words of one length; a letter that is no piece is the unknown one."""
        length, words = codes.shape
        hits: list[tuple[int, int, slice | np.ndarray, np.ndarray]] = []
        for k, h in enumerate(hashes(codes), start=1):
            at, ids = self.find(h.ravel())
            if k == 1:
                letters = np.zeros(codes.size, np.int32)
                letters[at] = ids
                hits += [(start, start + 1, slice(None), x) for start, x in enumerate(letters.reshape(codes.shape))]
                continue
            cuts = np.searchsorted(at, np.arange(1, len(h)) * words)
            for start, (row, i) in enumerate(zip(np.split(at, cuts), np.split(ids, cuts), strict=True)):
                if len(row):
                    hits.append((start, start + k, row - start * words, i))
        return Matches(words, length, sorted(hits, key=lambda hit: hit[0]))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes by letter and word) of the words of each length, the start mark included."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        codes = np.array([START + words[i] for i in at], dtype=f"U{n + 1}").view(np.uint32).reshape(len(at), n + 1)
        yield at, codes.T.astype(np.uint64, order="C")


def forward(found: Matches, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each beginning: (words, length + 1, languages)."""
    alpha = np.zeros((found.length + 1, found.words, prob.shape[1]))
    alpha[0] = 1
    for start, end, rows, ids in found.hits:
        alpha[end][rows] += alpha[start][rows] * prob[ids]
    return alpha.transpose(1, 0, 2)


def expected(found: Matches, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words in one language (``prob``: one column)."""
    alpha = forward(found, prob)[:, :, 0].T
    p = prob[:, 0]
    beta = np.zeros((found.length + 1, found.words))
    beta[found.length] = weight / alpha[found.length]
    counts = []
    for start, end, rows, ids in reversed(found.hits):
        through = p[ids] * beta[end][rows]
        beta[start][rows] += through
        counts.append(alpha[start][rows] * through)
    return np.bincount(np.concatenate([hit[3] for hit in reversed(found.hits)]), weights=np.concatenate(counts), minlength=len(p))


def words_of(text: str | None) -> list[str]:
    found: list[str] = []
    for part in (text or "").lower().replace(",", " ").replace(".", " ").split():
        if part.isalpha():  # most are one run as they stand
            found.append(part)
        else:
            found += LETTERS.findall(part)
    if found and not any(c.isalpha() for w in found for c in w):
        return []
    if found and max(map(len, found)) > LONGEST_WORD:
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    prob: np.ndarray  # piece probabilities by language
    vocabulary: str

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        pieces = vocabulary(self.vocabulary)
        out = np.empty((len(words), len(self.languages)))
        for at, codes in by_length(words):
            for i in range(0, len(at), 4096):
                part = slice(i, i + 4096)
                out[at[part]] = np.log(forward(pieces.matches(codes[:, part]), self.prob)[:, -1])
        return out


def joined(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Batches put together to ``least`` rows or more: words are worked through by length, a few at a time cost the most."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        kept.append(frame)
        if sum(map(len, kept)) >= least:
            yield pd.concat(kept)
            kept = []
    if kept:
        yield pd.concat(kept)


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all rows; tasks hold at most ``COUNTER_LIMIT`` distinct words before they pass them on."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, c in sums.items():
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c.keys()), "n": list(c.values())})
            sums.clear()

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                sums.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, sums.values())) > COUNTER_LIMIT:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return rows.mapInPandas(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rounds: int = 3, smoothing: float = 0.1, path: str | None = None
) -> LanguageModel:
    """Learn piece probabilities of every language of ``docs`` (all rows given)."""
    path = path or default_path()
    counts = saved(word_counts(docs, text_col, lang_col), "language-words")
    shares = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    seen = {r[0] for r in counts.select("lang").distinct().collect()}
    languages = sorted(set(shares) & seen)
    size = vocabulary(path).size
    prob = np.full((size, len(languages)), 1.0 / size)
    column = {lang: i for i, lang in enumerate(languages)}

    for _ in range(rounds if languages else 0):

        def step(frames: Iterator[pd.DataFrame], prob=prob) -> Iterator[pd.DataFrame]:
            pieces = vocabulary(path)
            total = np.zeros((size, len(languages)))
            for frame in joined(frames, STEP_ROWS):
                for lang, part in frame.groupby("lang"):
                    i = column[lang]
                    words, n = part["word"].tolist(), part["n"].to_numpy(dtype=float)
                    for at, codes in by_length(words):
                        for j in range(0, len(at), 4096):
                            cut = slice(j, j + 4096)
                            total[:, i] += expected(pieces.matches(codes[:, cut]), prob[:, [i]], n[at[cut]])
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": total[piece, lang]})

        sums = counts.mapInPandas(tidy(step, "pieces"), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        fresh = np.full((size, len(languages)), smoothing)
        for piece, lang, n in sums.collect():  # one row per piece and language at most
            fresh[piece, lang] += n
        prob = fresh / fresh.sum(axis=0)
    total = sum(shares[x] for x in languages)
    prior = np.log(np.array([shares[x] / total for x in languages]))
    return LanguageModel(languages, prior, prob, path)


class Places(dict):
    """Places of words in a table; a word that has none gets the next one."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class KnownWords:
    """Log probabilities of the words met so far, in two generations of at most ``limit`` words."""

    def __init__(self, model: LanguageModel, limit: int = CACHE_LIMIT):
        self.model, self.limit = model, limit
        self.row = Places()
        self.table = np.empty((1024, len(model.languages)))
        self.older = Places()
        self.older_table = self.table

    def learn(self, words: list[str]) -> np.ndarray:
        """Make sure that all of ``words`` are in the table; their places there."""
        known = len(self.row)
        places = self.row.of(words)
        if known < len(self.row) > self.limit and known:
            while len(self.row) > known:
                self.row.popitem()  # the last ones first
            self.older, self.older_table = self.row, self.table
            self.row, self.table, known = Places(), np.empty((1024, len(self.model.languages))), 0
            places = self.row.of(words)
        end = len(self.row)
        if end > len(self.table):
            grown = np.empty((max(end, 2 * len(self.table)), self.table.shape[1]))
            grown[:known] = self.table[:known]
            self.table = grown
        fresh = list(islice(self.row, known, None))
        old = np.array([self.older.get(w, -1) for w in fresh], dtype=np.int64)
        passed, unknown = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        self.table[known + passed] = self.older_table[old[passed]]
        self.table[known + unknown] = self.model.log_probs([fresh[i] for i in unknown])
        return places

    def total(self, words: list[str]) -> np.ndarray:
        return self.summed(self.row.of(words))

    def summed(self, places: np.ndarray) -> np.ndarray:
        return self.table[places].sum(axis=0)


def predict(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: dict[str, Column] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns (all, if not given) with the predicted language and its posterior share, called by ``names``.

    A task works through slices of texts of bounded length and remembers a bounded number of words.
    """
    if keep is None:
        rows, text, drop = docs, text_col, []
    else:
        text, drop = "__text", ["__text"]
        rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias(text))
    known_names = np.array([*model.languages, "und"], dtype=object)

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        known = KnownWords(model)

        def score(frame: pd.DataFrame) -> pd.DataFrame:
            texts = frame[text].tolist()
            best, share = np.full(len(texts), len(known_names) - 1), np.zeros(len(texts))
            first = length = 0
            for end, t in enumerate(texts, start=1):
                length += len(t or "")
                if length >= SLICE_CHARS or end == len(texts):
                    words = [words_of(t) for t in texts[first:end]] if model.languages else []
                    places = known.learn(list(chain.from_iterable(words)))
                    ends = np.cumsum([len(ws) for ws in words])
                    for i, ws, stop in zip(range(first, end), words, ends, strict=False):
                        if ws:
                            total = model.prior + known.summed(places[stop - len(ws) : stop])
                            best[i] = total.argmax()
                            share[i] = 1.0 / np.exp(total - total[best[i]]).sum()
                    first, length = end, 0
            return pd.DataFrame({names[0]: known_names[best], names[1]: share})

        return score

    return with_made(rows, [text], start, f"`{names[0]}` string, `{names[1]}` double", drop, keeps="pieces")
