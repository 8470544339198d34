"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of several families and languages, patterns, and words and stems learned from the
labelled training rows. Each votes toxic, clean or nothing. A generative label model learns from the votes on all
documents how likely each voter is to vote what when a text is toxic or clean (expectation maximisation over the
table of vote patterns; the given labels of training rows are one more voter with errors of its own), and how voters
correlate within a class; correlated voters share their weight. Its posterior is the label of a linear classifier
over votes, hit counts and hit density, which then scores every document.

Bounds: words and stems are learned from at most about ``label_rows`` labelled rows and the classifier is fitted on at most
about ``fit_rows`` rows, both drawn by hash; votes, their statistics and scores cover all documents. Of the drawn rows every
word and stem that passes the thresholds is learned, counted after copies are folded.

Defined results: null and empty texts get the votes of a text without hits and so a low score; a document without an
identifier has no label; repeated labels of one document count as toxic if any is; no labels at all leave the voters
to themselves; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import saved, with_made

WORD = re.compile(r"[^\W\d_]+")
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid dumb imbecile dimwit halfwit cretin brainless dunce",
    "worth": "trash scum worthless vermin filth useless lowlife parasite garbage maggot",
    "failing": "loser losers pathetic coward cowards spineless weakling failure",
    "ridicule": "clown clowns buffoon jerk jerks laughingstock creep weirdo",
    "disgust": "disgusting repulsive revolting sickening nauseating loathsome",
    "malice": "despise loathe detest slaughter exterminate murderer strangle subhuman",
    "swearing": "bastard bitch bullshit asshole fuck fucking shit crap dickhead",
    "german": "trottel dummkopf arschloch abschaum versager widerlich ekelhaft schwachkopf vollidiot mistkerl",
    "french": "imbécile crétin ordure pourriture minable dégoûtant connard salaud abruti",
    "spanish": "idiota imbécil estúpido basura escoria asqueroso patético cabrón gilipollas",
}
FAMILY = {w: f for f, ws in LEXICONS.items() for w in ws.split()}
PHRASES = re.compile(r"\b(?:shut up|go to hell|get lost|drop dead|halt die klappe|ferme ta gueule|vete al diablo)\b")
ADDRESSED = re.compile(r"\b(?:you|your|youre|u|du|dein|tu|ton|vous|eres|usted)\b(?:\W+\w+){0,4}$")
VOTERS = [*LEXICONS, "phrase", "addressed", "repeated", "several", "shouting", "masked", "learned_word", "learned_stem", "nothing", "label"]
FEATURES = len(LEXICONS) + 4
LEAST_USES, LEAST_Z, LEAST_SHARE = 15, 10.0, 0.8
WORD_LIMIT = 1_000_000
DOCUMENT = ""
PLACES_HELD = 200_000


STEMS = range(3, 7)
END = "$"


def units(word: str) -> list[str]:
    """What may be learned of a word: its beginnings of 3 to 6 letters, and the whole of it."""
    return [*[word[:k] for k in STEMS if k <= len(word)], word + END]


class Learned(dict):
    """Word -> 0 not learned, 1 as a whole word, 2 by its stem; remembered within a task."""

    def __init__(self, chosen: frozenset[str]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_LIMIT:
            self.clear()
        hit = [u for u in units(word) if u in self.chosen]
        kind = self[word] = 0 if not hit else 1 if hit[0].endswith(END) else 2
        return kind


def vote(text: str | None, learned: Learned) -> tuple[str, list[float]]:
    """One character per voter (``+`` toxic, ``-`` clean, ``0`` nothing; the label is filled in later) and the hit counts."""
    raw = text or ""
    lower = raw.lower()
    words = WORD.findall(lower)
    hits = [w for w in words if w in FAMILY]
    kinds = Counter(map(learned.__getitem__, words)) if learned.chosen else Counter()
    by_family = Counter(FAMILY[w] for w in hits)
    n = Counter(hits)
    addressed = any(ADDRESSED.search(lower[max(0, m.start() - 60) : m.start()]) for w in n for m in re.finditer(rf"\b{w}\b", lower))
    letters = sum(map(str.isalpha, raw)) if "!!" in raw else 0
    yes = {
        **{f: by_family[f] > 0 for f in LEXICONS},
        "phrase": PHRASES.search(lower) is not None,
        "addressed": addressed,
        "repeated": max(n.values(), default=0) > 1,
        "several": len(n) > 1,
        "shouting": letters > 20 and sum(map(str.isupper, raw)) > 0.6 * letters,
        "masked": "***" in raw or "###" in raw,
        "learned_word": kinds[1] > 0,
        "learned_stem": kinds[2] > 0,
    }
    nothing = not (hits or kinds[1] or kinds[2] or yes["phrase"])
    signs = "".join("+" if yes[v] else "0" for v in VOTERS[:-2]) + ("-" if nothing else "0")
    density = 100.0 * (len(hits) + kinds[1] + kinds[2]) / max(len(words), 1)
    counts = [*[math.log1p(by_family[f]) for f in LEXICONS], math.log1p(kinds[1]), math.log1p(kinds[2])]
    return signs, [*counts, math.log1p(density), math.log1p(len(n))]


def often_toxic() -> Column:
    return F.col("toxic") >= F.greatest(F.lit(LEAST_USES), LEAST_SHARE * (F.col("toxic") + F.col("clean")))


def folded(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(word, toxic, clean): in how many places a unit stands, by class. ``rows``: (text, toxic, whole).

    A place is a word with its neighbours. A document counts by one place of each unit, its least, and equal places
    count once, so copies and near copies count as one document. Only ``wanted`` units count; if None, all units of
    the ``whole`` rows, and the unit DOCUMENT: one place of every row, the least by checksum.
    """

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, int]] = set()
        for frame in frames:
            for t, y, whole in zip(frame["text"], frame["toxic"], frame["whole"], strict=True):
                words = ["", *WORD.findall((t or "").lower()), ""]
                around = [" ".join(w) for w in zip(words, words[1:], words[2:], strict=False)]
                if wanted is None and around:
                    seen.add((DOCUMENT, min(around, key=lambda p: crc32(p.encode())), y))
                by_word: dict[str, str] = {}
                for w, place in zip(words[1:] if whole else [], around, strict=False):
                    by_word[w] = min(by_word.get(w, place), place)
                least: dict[str, str] = {}
                for w, place in by_word.items():
                    for u in units(w):
                        if wanted is None or u in wanted:
                            least[u] = min(least.get(u, place), place)
                seen |= {(u, place, y) for u, place in least.items()}
                if len(seen) > PLACES_HELD:
                    yield pd.DataFrame(list(seen), columns=["word", "place", "y"])
                    seen = set()
        yield pd.DataFrame(list(seen), columns=["word", "place", "y"])

    used = rows.select("text", "toxic", "whole").mapInPandas(places, "word string, place string, y int")
    toxic, clean = (F.sum((F.col("y") == y).cast("long")).alias(name) for y, name in ((1, "toxic"), (0, "clean")))
    return used.select("word", F.xxhash64("place").alias("place"), "y").distinct().groupBy("word").agg(toxic, clean)


def learned_units(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_rows: int) -> list[str]:
    """Words and stems far more frequent in toxic than in clean training documents. ``labels``: (id, toxic), one row per document.

    Copies of a document share all their rare words. So both a unit's counts and the base share are counts of places.
    """
    total = labels.count()
    share = min(1.0, label_rows / max(total, 1))
    drawn = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")

    # Before all clean documents are counted, a sixteenth of them is: further documents only add clean places, so a unit
    # whose toxic share is too low by then stays below it and is not looked up again.
    some = rows.withColumn("whole", (F.col("toxic") == 1) | (F.pmod(F.xxhash64("id", F.lit("first")), F.lit(16)) == 0))
    first = {r["word"]: r for r in folded(some, None).where((F.col("word") == DOCUMENT) | often_toxic()).collect()}
    sides = first.pop(DOCUMENT, {"toxic": 0, "clean": 1})
    base = min(max(sides["toxic"] / max(sides["toxic"] + sides["clean"], 1), 1e-3), 0.5)
    if not first:
        return []

    # Toxic share far above the base share, by the binomial deviation; of equals the longest first.
    seen = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - seen * base) / F.sqrt(seen * base * (1 - base))
    strong = folded(rows.withColumn("whole", F.lit(True)), frozenset(first)).where(often_toxic() & (z > LEAST_Z))
    out: dict[str, None] = {}
    begun: set[str] = set()  # what is chosen, and its beginnings
    for (unit,) in strong.orderBy(F.desc(F.round(z, 6)), F.desc(F.length("word")), "word").select("word").collect():
        starts = {unit, *(unit[:k] for k in STEMS if k < len(unit))}
        if unit not in begun and not any(u in out for u in starts):
            out[unit] = None
            begun |= starts
    return list(out)


class LabelModel:
    """Vote probabilities by class, class share, and a weight per voter for correlation."""

    def __init__(self, voters: int):
        self.voters = voters
        self.log = np.zeros((2, voters, 3))  # log P(vote | class); votes in the order - 0 +
        self.prior = math.log(0.1 / 0.9)
        self.weight = np.ones(voters)

    @staticmethod
    def coded(patterns: list[str]) -> np.ndarray:
        table = np.zeros(128, dtype=np.int64)
        table[[ord("-"), ord("0"), ord("+")]] = [0, 1, 2]
        return table[np.array([list(p.encode()) for p in patterns], dtype=np.int64).reshape(len(patterns), -1)]

    def first_guess(self, votes: np.ndarray) -> np.ndarray:
        """Majority of the votes cast, ties and silence to the clean side."""
        return np.where((votes - 1).sum(axis=1) > 0, 0.98, 0.02)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = self.log[1] - self.log[0]
        odds[:, 1] = 0  # no vote says nothing: most voters know one language or one kind of insult
        logit = self.prior + (odds[np.arange(self.voters), votes] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, patterns: DataFrame, rounds: int = 12) -> LabelModel:
        """``patterns``: (pattern, n). Every round is one pass over that table and returns sums by voter, vote and class."""
        for r in range(rounds):
            guess, me = r == 0, self
            pairs = r == rounds // 2

            def step(frames: Iterator[pd.DataFrame], me=me, guess=guess, pairs=pairs) -> Iterator[pd.DataFrame]:
                v = me.voters
                sums, cross = np.zeros((2, v, 3)), np.zeros((2, v, v))
                for frame in frames:
                    votes, n = me.coded(frame["pattern"].tolist()), frame["n"].to_numpy(dtype=float)
                    p = me.first_guess(votes) if guess else me.posterior(votes)
                    for y, w in ((0, n * (1 - p)), (1, n * p)):
                        for k in range(3):
                            sums[y, :, k] += w @ (votes == k)
                        if pairs:
                            s = (votes - 1).astype(float)
                            cross[y] += (s * w[:, None]).T @ s
                flat = np.concatenate([sums.ravel(), cross.ravel()]) if pairs else sums.ravel()
                yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

            got = patterns.mapInPandas(step, "i long, x double").groupBy("i").agg(F.sum("x")).collect()
            flat = np.zeros(2 * self.voters * (3 + (self.voters if pairs else 0)))
            for i, x in got:
                flat[i] = x
            sums = flat[: 6 * self.voters].reshape(2, self.voters, 3)
            if sums.sum() == 0:
                return self
            if pairs:
                self.weight = self.shared(sums, flat[6 * self.voters :].reshape(2, self.voters, self.voters))
            smooth = sums + 0.5
            self.log = np.log(smooth / smooth.sum(axis=2, keepdims=True))
            mass = sums[:, 0, :].sum(axis=1) + 1.0
            self.prior = math.log(mass[1] / mass[0])
        return self

    @staticmethod
    def shared(sums: np.ndarray, cross: np.ndarray) -> np.ndarray:
        """1 / (1 + correlation with the other voters within a class, the larger of both classes).

        The label is independent of the text's voters within a class, and the vote for nothing found stands for the
        silence of all of them at once, which counts nowhere else: both keep their whole weight.
        """
        total = np.zeros(sums.shape[1])
        for y in range(2):
            n = max(sums[y, 0].sum(), 1e-9)
            mean = (sums[y, :, 2] - sums[y, :, 0]) / n
            cov = cross[y] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0)
            np.fill_diagonal(corr, 0)
            corr[[VOTERS.index("nothing"), VOTERS.index("label")]] = 0
            corr[:, [VOTERS.index("nothing"), VOTERS.index("label")]] = 0
            total = np.maximum(total, np.clip(corr, 0, 1).sum(axis=1))
        return 1 / (1 + total)


def inputs(patterns: list[str], hits: np.ndarray) -> np.ndarray:
    """Classifier inputs: votes (without the label's) as two columns each, hit counts, and a constant."""
    votes = LabelModel.coded(patterns)[:, : len(VOTERS) - 1]
    return np.hstack([votes == 2, votes == 0, hits, np.ones((len(hits), 1))]).astype(np.float64)


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - q) - ridge * w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_rows: int = 20_000,
    fit_rows: int = 50_000,
) -> DataFrame:
    """(id, train, score, posterior, votes) of every document. ``train`` tells, from the id, whose labels may be learned."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(train).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = saved(known, "toxicity-labels")
    chosen = frozenset(learned_units(docs, known, id_col, text_col, label_rows))

    def look() -> Callable[[pd.DataFrame], pd.DataFrame]:
        learned = Learned(chosen)

        def votes_of(frame: pd.DataFrame) -> pd.DataFrame:
            seen = [vote(t, learned) for t in frame["text"]]
            hits = np.array([x for _, x in seen], dtype=np.float32).reshape(len(seen), FEATURES)
            return pd.DataFrame({"votes": [v for v, _ in seen], "hits": [h.tobytes() for h in hits]})

        return votes_of

    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).alias("text"))
    votes = saved(with_made(rows, ["text"], look, "votes string, hits binary", drop=["text"]), "toxicity-votes")
    sign = F.when(F.col("toxic") == 1, "+").when(F.col("toxic") == 0, "-").otherwise("0")
    voted = votes.join(known, "id", "left").withColumn("pattern", F.concat("votes", sign))
    patterns = saved(voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "toxicity-patterns")
    model = LabelModel(len(VOTERS)).fit(patterns)

    total = votes.count()
    share = min(1.0, fit_rows / max(total, 1))
    drawn = voted.where(F.col("train") & (F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = drawn.select("pattern", "hits").toPandas()  # about fit_rows rows of some hundred bytes

    def features(frame: pd.DataFrame, column: str) -> np.ndarray:
        hits = np.frombuffer(b"".join(frame["hits"]), dtype=np.float32).reshape(len(frame), FEATURES)
        return inputs(frame[column].tolist(), hits)

    weights = np.zeros(2 * (len(VOTERS) - 1) + FEATURES + 1)
    if len(sample):
        weights = logistic(features(sample, "pattern"), model.posterior(model.coded(sample["pattern"].tolist())))

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        value = 1 / (1 + np.exp(-np.clip(features(frame, "votes") @ weights, -30, 30)))
        return pd.DataFrame({"score": value, "posterior": model.posterior(model.coded([v + "0" for v in frame["votes"]]))})

    scored = with_made(votes, ["votes", "hits"], lambda: judged, "score double, posterior double", drop=["hits"])
    return scored.select("id", "train", "votes", "score", "posterior")
