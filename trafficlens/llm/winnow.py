"""Document fingerprints by winnowing, in SQL array functions only.

A text is cut at white space; every run of ``k`` words has a rolling hash (rotate and xor over word hashes); of every
``window`` consecutive run hashes the smallest is chosen, the rightmost one on ties. Two texts that share a passage of
at least ``k + window - 1`` words share a chosen hash inside it, and runs shorter than ``k`` words are never matched.
A chosen entry keeps its word position: value and position are packed into one long, hash in the upper bits and the
complement of the position in the lower ones, so that the plain minimum prefers the rightmost of equal hashes.

Defined results: null counts as empty; a text without words has an empty fingerprint; with fewer than ``k`` words the
hash of all its words is the one entry; with fewer than ``window`` runs the smallest of them is chosen. Positions
count up to 2^24 words, hashes have 39 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import in_order, saved, with_prefix

POSITION_BITS = 24
POSITION_MASK = (1 << POSITION_BITS) - 1
HASH_BITS = 63 - POSITION_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an array to a lambda variable: the optimizer cannot copy its computation into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rotl(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def appended(first: Column, second: Column, length: int, more: int) -> Column:
    """Hashes of ``length + more`` words: runs of ``length``, each followed by the run of ``more`` words after it."""
    return F.transform(
        F.slice(first, 1, F.greatest(F.size(second) - length, F.lit(0))),
        lambda x, i: rotl(x, more).bitwiseXOR(F.get(second, i + length)),
    )


def run_hashes(hashes: Column, k: int) -> Column:
    """Rolling hash of every ``k`` consecutive word hashes, from runs of 1, 2, 4, ... words: 5 is 4 and 1."""

    def grow(powers: list[Column]) -> Column:
        length = 1 << (len(powers) - 1)
        if 2 * length <= k:
            return let(appended(powers[-1], powers[-1], length, length), lambda c: grow([*powers, c]))
        return finish(powers[-1], length, powers)

    def finish(current: Column, length: int, powers: list[Column]) -> Column:
        if length == k:
            return current
        bit = (k - length).bit_length() - 1
        return let(appended(current, powers[bit], length, 1 << bit), lambda c: finish(c, length + (1 << bit), powers))

    return grow([hashes])


def sliding_min(values: Column, window: int) -> Column:
    """Minimum of every ``window`` neighbours by doubling; the minimum of all if there are fewer."""

    def step(current: Column, length: int) -> Column:
        if length == window:
            return current
        shift = min(length, window - length)
        lower = F.transform(
            F.slice(current, 1, F.greatest(F.size(current) - shift, F.lit(0))),
            lambda x, i: F.least(x, F.get(current, i + shift)),
        )
        return let(lower, lambda c: step(c, length + shift))

    return F.when(F.size(values) < window, F.filter(F.array(F.array_min(values)), lambda v: v.isNotNull())).otherwise(step(values, 1))


def chosen(text: Column, k: int = 5, window: int = 8) -> Column:
    """Packed entries (hash and position) of a text's fingerprint, without repeats, in ascending order of hash."""

    def from_hashes(h: Column) -> Column:
        whole = F.filter(F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: rotl(a, 1).bitwiseXOR(x))), lambda v: F.size(h) > 0)
        runs = F.when(F.size(h) < k, whole).otherwise(run_hashes(h, k))
        packed = F.transform(
            runs,
            lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x), 64 - HASH_BITS), POSITION_BITS).bitwiseOR(
                F.lit(POSITION_MASK).cast("long") - F.least(i, F.lit(POSITION_MASK)).cast("long")
            ),
        )
        return let(packed, lambda p: F.array_sort(F.array_distinct(sliding_min(p, window))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), from_hashes)


def hashes_of(entries: Column) -> Column:
    """The distinct hashes of packed entries."""
    return F.array_distinct(F.transform(entries, lambda e: F.shiftrightunsigned(e, POSITION_BITS)))


def positions_of(entries: Column) -> Column:
    """Word positions in the order of :func:`chosen`."""
    return F.transform(entries, lambda e: F.lit(POSITION_MASK).cast("long") - e.bitwiseAND(POSITION_MASK))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty ones are alike, an empty and another one are not."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Who follows whom by ascending id, without the texts.

    (id, h, share, next_id, next_h): ``h`` tells rows of one id apart, ``share`` is a quarter of the text's code points.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.floor(F.char_length(text) / 4).cast("int").alias("share"))
    ordered = in_order(slim, ["id", "h"], "winnow-order")
    placed = saved(with_prefix(ordered, {"at": F.lit(1).cast("long")}).select("id", "h", "share", "at"), "winnow-places")
    total = placed.count()
    following = placed.select(
        F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at")
    )
    return placed.join(following, "at").drop("at")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """Every document with its fingerprint, its edited text and both likenesses.

    (id, text, edited, entries, edited_entries, near_edited, near_next). The edited text has the last quarter of the
    code points replaced by the first as many of the next document by ascending id (ties by content hash; the last
    document is followed by the first). Texts are dealt once, by id and content hash, and that exchange serves the
    fetching of a neighbour's opening as well as the final join; only a quarter of the text travels a second time.
    """
    # plain keys, so that the dealing by them for the first row of each key is also the one the joins need
    key = ["unnamed", "name", "h"]

    def keyed(id_: str, h: str, tag: str = "") -> list[Column]:
        return [F.col(id_).isNull().alias(f"{tag}unnamed"), F.coalesce(F.col(id_), F.lit(0)).alias(f"{tag}name"), F.col(h).alias(f"{tag}h")]

    pairs = neighbours(docs, id_col, text_col).select(*keyed("id", "h", "of_"), F.col("share").alias("of_share"), *keyed("next_id", "next_h"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).select(*keyed("id", "hash"), "text")
    first = Window.partitionBy(*key).orderBy("h")
    texts = rows.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    opening = texts.join(pairs, key).select(
        *[F.col(f"of_{c}").alias(c) for c in key], "of_share",
        F.left("text", F.col("of_share")).alias("opening"), hashes_of(chosen(F.col("text"), k, window)).alias("next_hashes"),
    )
    own = texts.join(opening, key).select(
        F.when(~F.col("unnamed"), F.col("name")).alias("id"), "text", F.concat(F.left("text", F.char_length("text") - F.col("of_share")), "opening").alias("edited"), "next_hashes"
    )

    def result(entries: Column, other: Column) -> Column:
        return let(
            hashes_of(entries),
            lambda mine: let(
                hashes_of(other),
                lambda theirs: F.struct(
                    entries.alias("entries"), other.alias("edited_entries"), mine.alias("hashes"), theirs.alias("edited_hashes"),
                    likeness(mine, theirs).alias("near_edited"), likeness(mine, F.col("next_hashes")).alias("near_next"),
                ),
            ),
        )

    # a generator keeps the fingerprints from being copied into every column that uses them
    made = let(chosen(F.col("text"), k, window), lambda a: let(chosen(F.col("edited"), k, window), lambda b: result(a, b)))
    return own.select("id", "text", "edited", F.inline(F.array(made)))
