"""Collocations by relational mining of ever longer phrases (SETM).

The occurrence relation of phrases of k words holds one entry per place where such a phrase starts, in the order of
piece and position. It is kept as slices of about half a million places: the slice's distinct phrases, a line each (no
phrase holds a line break), and, place by place, the number of the phrase that starts there (0: none; the place after a
piece's last word is always 0). Whole pieces stay in one slice, so the entry of the next position is the next place, and
joining the relation with itself on the same piece and adjacent positions is a merge of two neighbouring entries:

1. the words of all texts are written as the relation of length 1, with their counts per slice;
2. counts are summed by language and phrase over all slices; phrases seen less than ``least`` times are dropped;
3. the relation is cut to the frequent phrases before it is joined to the next length (a longer phrase needs both of its
   shorter parts), and the longer phrases are counted in turn. What is joined once more is written first.

The cut in 3 goes through a bit table of the frequent phrases' hashes, of at most ``MOST_BITS`` bits whatever their
number, which is what is broadcast. An infrequent phrase may slip through a shared bit; its count drops it later, so the
result does not depend on the table. Each slice leaves one row per phrase for the counts. Phrases of several words
repeat little between the slices of a task, so their rows are dealt by phrase as they are and summed once, after that.

Defined results: a null text is empty; a null language is ``und``; words are compared after lower-casing A-Z only;
repeated rows count again; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import saved
from trafficlens.llm.worker_memory import tidy

SLICE = 1 << 19
ROWS_AT_ONCE = 1 << 14
#: Slices are long rows: small row groups and pages, so that writer and reader hold few at a time, however well they
#: compress. Sizes are looked at after every row; by default they are after a hundred, more than a task has.
GROUPS = {
    "parquet.block.size": str(4 << 20),
    "parquet.block.row.count.limit": "4",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}
STEP_BYTES = 1 << 20
MOST_BITS = 1 << 28
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * 10)
RELATION = "lang string, phrases string, places binary"


class Slice:
    """A slice that is being filled: distinct words (numbers from 1) and their places."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b"\xff": 0}
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        tokens = b"\xff".join([*texts, b""]).translate(LOWER).replace(b"\xff", b" \xff ").split()
        numbers = self.numbers
        for word in dict.fromkeys(tokens):
            if word not in numbers:
                numbers[word] = len(numbers)
        self.places.append(np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def row(self, lang: str) -> pa.RecordBatch:
        places = np.concatenate(self.places)
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        return relation_row(lang, words, places)


def relation_row(lang: str, phrases: pa.Array, places: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(phrases)], pa.int32()), phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang]), pc.binary_join(lists, "\n"), pa.array([places.astype("<i4").tobytes()], pa.binary())], names=["lang", "phrases", "places"])


def word_relation(docs: DataFrame, text_col: str, lang_col: str, slice_places: int) -> DataFrame:
    """The occurrence relation of length 1; a task fills one slice per language at a time."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, Slice] = {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                step, size = [], 0
                texts = batch.column("text").filter(pc.equal(langs, lang))
                for i, text in enumerate(texts, start=1):
                    step.append(text.as_py())
                    size += len(step[-1])
                    if size >= STEP_BYTES or i == len(texts):
                        slices.setdefault(lang, Slice()).add(step)
                        step, size = [], 0
                        if slices[lang].size >= slice_places:
                            yield slices.pop(lang).row(lang)
            while sum(s.size for s in slices.values()) > slice_places:
                largest = max(slices, key=lambda x: slices[x].size)
                yield slices.pop(largest).row(largest)
        for lang, part in slices.items():
            yield part.row(lang)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(tidy(fill), RELATION)


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lines = batch.column("phrases").slice(i, 1)
            phrases = pc.split_pattern(lines, "\n").flatten() if lines[0].as_buffer().size else lines[:0]
            yield batch.column("lang")[i].as_py(), phrases, np.frombuffer(batch.column("places")[i].as_buffer(), dtype="<i4")


def joined(phrases: pa.Array, places: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Phrases one word longer: (distinct phrases, their counts in the slice, places) from entries at adjacent positions."""
    both = np.flatnonzero((places[:-1] > 0) & (places[1:] > 0))
    code = places[both].astype(np.int64) * (len(phrases) + 1) + places[both + 1]
    code, number, counts = np.unique(code, return_inverse=True, return_counts=True)
    first, second = np.divmod(code, len(phrases) + 1)
    tails = pc.replace_substring_regex(phrases, pattern="^.* ", replacement="")
    longer = pc.binary_join_element_wise(phrases.take(pa.array(first - 1)), tails.take(pa.array(second - 1)), " ")
    at = np.zeros(len(places), dtype=np.int32)
    at[both] = number + 1
    return longer, counts, at


class FrequentBits:
    """A table of one bit per hash value; True for every phrase it was built from."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __call__(self, lang: str, phrases: pa.Array) -> np.ndarray:
        head = f"{lang}\n".encode()
        h = np.fromiter((xxhash.xxh64_intdigest(head + p, 42) for p in phrases.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(phrases))
        at = h & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def frequent_bits(frequent: DataFrame) -> FrequentBits:
    """The bit table of a frequent relation: 16 bits a phrase, within ``MOST_BITS``; made by tasks, 64 bits a row collected."""
    bits = 64
    while bits < min(16 * frequent.count(), MOST_BITS):
        bits *= 2
    at = F.xxhash64(F.concat_ws("\n", "lang", "phrase")).bitwiseAND(bits - 1)
    rows = frequent.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word"))
    rows = rows.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("mask"))
    found = rows.toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return FrequentBits(bits, words)


def cut(phrases: pa.Array, places: np.ndarray, held: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The slice with the phrases of ``held`` only."""
    number = np.zeros(len(phrases) + 1, dtype=np.int32)
    number[1:][held] = np.arange(1, held.sum() + 1)
    return phrases.filter(pa.array(held)), number[places]


def summed(counts: DataFrame, least: int) -> DataFrame:
    """The counts of phrases summed over slices; they are dealt first, as a table of sums before would be nearly as long."""
    return counts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def word_counts(relation: DataFrame) -> DataFrame:
    """(lang, phrase, n) of the relation of length 1, a row per word and slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, phrases, places in slices_of(batches):
            yield from counted(lang, phrases, np.bincount(places, minlength=len(phrases) + 1)[1:])

    return relation.mapInArrow(tidy(count), "lang string, phrase string, n long")


def counted(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), ROWS_AT_ONCE):
        some, n = phrases.slice(i, ROWS_AT_ONCE), counts[i : i + ROWS_AT_ONCE].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(n)], names=["lang", "phrase", "n"])


def longer_counts(relation: DataFrame, shorter: object) -> DataFrame:
    """(lang, phrase, n) of the phrases one word longer, a row per phrase and slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, phrases, places in slices_of(batches):
            longer, n, _ = joined(*cut(phrases, places, shorter.value(lang, phrases)))
            yield from counted(lang, longer, n)

    return relation.mapInArrow(tidy(count), "lang string, phrase string, n long")


def longer_relation(relation: DataFrame, shorter: object, longer: object) -> DataFrame:
    """The relation one word longer, cut to its frequent phrases."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, phrases, places in slices_of(batches):
            found, _, at = joined(*cut(phrases, places, shorter.value(lang, phrases)))
            yield relation_row(lang, *cut(found, at, longer.value(lang, found)))

    return relation.mapInArrow(tidy(join), RELATION)


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, slice_places: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) word counts per language and, for each length, the phrases seen at least ``least`` times (lang, phrase, n)."""
    send = docs.sparkSession.sparkContext.broadcast
    relation = saved(word_relation(docs, text_col, lang_col, slice_places), "setm-places", **GROUPS)
    words = saved(word_counts(relation).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "setm-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    found = [words.where(F.col("n") >= least)]
    held = send(frequent_bits(found[0]))
    for length in range(2, longest + 1):
        found.append(saved(summed(longer_counts(relation, held), least), f"setm-frequent-{length}"))
        if length < longest:
            longer = send(frequent_bits(found[-1]))
            relation = saved(longer_relation(relation, held, longer), f"setm-places-{length}", **GROUPS)
            held = longer
    return totals, found


def part(phrase: Column, start: int, words: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), start, words), " ")


def scored(found: list[DataFrame], length: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of one length by their weakest cut."""
    rows = found[length - 1].select("lang", "phrase", F.col("n").alias("a"))
    for k in range(1, length):
        left = found[k - 1].select("lang", F.col("phrase").alias(f"p{k}"), F.col("n").alias(f"l{k}"))
        right = found[length - k - 1].select("lang", F.col("phrase").alias(f"q{k}"), F.col("n").alias(f"r{k}"))
        rows = rows.withColumns({f"p{k}": part(F.col("phrase"), 1, k), f"q{k}": part(F.col("phrase"), k + 1, length - k)})
        rows = rows.join(left, ["lang", f"p{k}"]).join(right, ["lang", f"q{k}"])
    exact = "cast(a AS decimal(19,0)) * a * 1000000 div (cast(l{k} AS decimal(19,0)) * r{k})"
    cuts = [F.struct(F.expr(exact.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
    weakest = F.array_min(F.array(*cuts))
    return rows.select("lang", "phrase", "a", weakest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_parts(rows: DataFrame, longer: list[DataFrame], length: int, share: int) -> DataFrame:
    """The rows whose phrase does not lie inside a longer candidate that has ``share`` percent of its occurrences."""
    inside = None
    for more, phrases in enumerate(longer, start=1):
        spots = F.array(*[part(F.col("phrase"), i, length) for i in range(1, more + 2)])
        one = phrases.select("lang", F.explode(F.array_distinct(spots)).alias("phrase"), "n")
        inside = one if inside is None else inside.union(one)
    if inside is None:
        return rows
    largest = inside.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    joined_rows = rows.join(largest, ["lang", "phrase"], "left")
    return joined_rows.where(F.coalesce(100 * F.col("within") < share * F.col("a"), F.lit(True))).drop("within")


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    slice_places: int = SLICE,
) -> DataFrame:
    """The first ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score)."""
    totals, found = frequent_phrases(docs, text_col, lang_col, longest, least, slice_places)
    kept = None
    for length in range(2, longest + 1):
        rows = without_parts(scored(found, length), found[length:], length, share)
        kept = rows if kept is None else kept.union(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within 64 shares of a language, so that no task gets all of its candidates
    shares = Window.partitionBy("lang", "share").orderBy(*order)
    first = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
