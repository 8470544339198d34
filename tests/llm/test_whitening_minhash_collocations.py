"""Operators 11 to 13 against numpy, brute force over all pairs and plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm import collocations, minhash_dedup, whitening
from trafficlens.llm.common import saved

# ---- 11: whitening ----

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("keep", T.StringType())])


def symmetric(size, rank, seed):
    m = np.random.default_rng(seed).standard_normal((size, rank))
    return m @ m.T


MATRICES = {
    "full": symmetric(40, 60, 1), "rank 3": symmetric(30, 3, 2), "equal": np.eye(20), "diagonal": np.diag(np.arange(10.0)), "ones": np.ones((25, 25)),
    "pairs": np.kron(np.eye(4), [[2.0, 1.0], [1.0, 2.0]]), "one": np.array([[4.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "huge": 1e30 * symmetric(20, 40, 3),
    "nearly equal": np.eye(30) + 1e-9 * symmetric(30, 30, 4), "paths": np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
}


@pytest.mark.parametrize("name", MATRICES)
def test_components_are_eigenvectors(name):
    a = MATRICES[name]
    values, vectors = whitening.leading_components(a, 32)
    want = np.linalg.eigvalsh(a)[::-1]
    want = want[want > whitening.RANK_SHARE * want[0]][:32]
    assert len(values) == len(want)
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * want[0] * len(a)


def test_no_variance_gives_no_components():
    values, vectors = whitening.leading_components(np.zeros((5, 5)), 3)
    assert len(values) == 0 and vectors.shape == (5, 0)


def test_sturm_counts_zero_pivots():
    counts = whitening.sturm_count(np.array([1.0, 1.0]), np.array([0.5]), np.array([0.4, 1.0, 1.6]))
    assert counts.tolist() == [0, 1, 2]


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = (rng.standard_normal((300, 8)) * [3, 1, 1, 0.5, 2, 0, 1, 1] + 40).astype(np.float32)
    odd = [(None, None, "a"), (900, [], "b"), (901, [1.0] * 7 + [None], "c"), (902, [1.0] * 7 + [float("nan")], "d"), (903, [float("inf")] * 8, "e"), (904, [1.0] * 3, "f")]
    big = 2**60
    rows = [(big + i if i else None, [float(c) for c in v], "x") for i, v in enumerate(values)]
    made, model = whitening.whiten(vectors_frame(spark, rows + odd), "embedding", ["vec_id", "keep"], 5)
    got = {r["keep"]["vec_id"]: r for r in made.collect()}
    assert set(got) == {r[0] for r in rows} and model.n == 300
    x = np.floor(64 * values.astype(np.float64)).astype(np.int64) + 1_000_000
    d = x - x.mean(axis=0)
    e, q = np.linalg.eigh(d.T @ d / 300)
    want = (d @ q / np.sqrt(np.where(e > 1e-9, e, 1)))[:, ::-1][:, :5]
    found = np.array([got[r[0]]["whitened"] for r in rows])
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-9
    exact = [sum((300 * int(c) - int(s)) ** 2 for c, s in zip(v, x.sum(axis=0), strict=True)) for v in x]
    assert [int(got[r[0]]["deviation"]) for r in rows] == exact
    assert model.identity_error < 1e-10
    assert np.allclose(model.explained, e[::-1][:5] / e.sum(), rtol=1e-10)
    long = whitening.long_form(made, model)
    assert long.count() == 1500 and long.where("component = 1 and n = 300").count() == 300


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, [1.0, 2.0], "a")], [(1, [1.0, 2.0], "a")] * 4])
def test_no_components_no_rows(spark, rows):
    made, model = whitening.whiten(vectors_frame(spark, rows), "embedding", ["vec_id"])
    assert whitening.long_form(made, model).count() == 0
    assert made.count() == sum(r[1] is not None for r in rows)


def test_huge_entries_keep_deviations_exact(spark):
    rows = [(1, [1e30, 0.0], "a"), (2, [-1e30, 1.0], "a"), (3, [2.0**30, 5.0], "a")]
    made, model = whitening.whiten(vectors_frame(spark, rows), "embedding", ["vec_id"])
    c = {1: (2**40, 0), 2: (-(2**40), 1), 3: (2**30, 5)}
    sums = [sum(v[i] for v in c.values()) * 64 for i in range(2)]
    for r in made.collect():
        assert int(r["deviation"]) == sum((3 * 64 * v - s) ** 2 for v, s in zip(c[r["keep"]["vec_id"]], sums, strict=True))


# ---- 12: min-hash groups ----


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    known = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return Counter((r[0], len(sets[i]), known[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def family_rows(seed, families=12, members=14):
    """Families of texts with edits of many sizes, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(families):
        base = rng.choices(words, k=rng.choice([12, 60, 200]))
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 997 + 1000 * f, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, frame, odd, seed, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "SET_BLOCK", 3)
    rows = family_rows(seed) + odd + [(2**60 + 1, "one two three four five six seven"), (None, "One two\x0bthree four five six seven"), (2**60 + 3, "one two three")]
    _, docs = frame(rows)
    got = minhash_dedup.near_groups(docs.withColumn("component_id", F.lit(5)).withColumn("node", F.lit("x")))
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_a_chain_is_one_group(spark, frame):
    words = [f"t{i}" for i in range(300)]
    rows = [(100 - i, " ".join(words[2 * i : 2 * i + 100])) for i in range(60)]
    _, docs = frame(rows)
    assert {r["component_id"] for r in minhash_dedup.near_groups(docs).collect()} == {41}


def test_groups_of_an_empty_table(spark, frame):
    _, docs = frame([(1, "x")])
    assert minhash_dedup.near_groups(docs.limit(0)).count() == 0


def test_star_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3, 2)]
    got = dict(map(tuple, minhash_dedup.star_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()))
    assert got == {**{i: 1 for i in range(2, 201)}, **{i: 1000 for i in range(1001, 1100)}}


# ---- 13: collocations ----


def plain_collocations(rows, least, share, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, *rest in rows:
        lang = (rest[0] if rest else None) or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        for p in candidates:
            a = f[p]
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = [q for q in candidates if len(q) > len(p) and p in [q[i : i + len(p)] for i in range(len(q))]]
            if not any(100 * f[q] >= share * a for q in inside):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "über", "ß", "a", "b", "São", "x"]
    fixed = ["new york city", "new york", "of the", "a a a a", "über ß"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice(marks) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("slice_places", [50, 1 << 22])
def test_collocations_equal_plain_counting(spark, frame, odd, slice_places):
    rows = phrase_rows(3) + odd
    _, docs = frame(rows)
    got = collocations.mine(docs.withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)), least=3, top=15, slice_places=slice_places)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 3, 50, 15)


def test_bit_table_holds_every_phrase(spark):
    rows = [("en", f"word{i} w{i % 7}") for i in range(500)]
    bits = collocations.frequent_bits(spark.createDataFrame(rows, "lang string, phrase string"))
    import pyarrow as pa

    assert bits("en", pa.array([p for _, p in rows])).all()
    assert bits("fr", pa.array([p for _, p in rows])).mean() < 0.2


def test_long_rows_are_written_in_small_groups(spark):
    """A task writes few slices of megabytes each: they must not meet in one row group, nor in one page."""
    long = spark.range(24, numPartitions=1).select(F.lit("en").alias("lang"), F.lit("a\nb").alias("phrases"), F.expr("encode(repeat(uuid(), 30000), 'utf-8')").alias("places"))
    (path,) = saved(long, "test-places", **collocations.GROUPS).inputFiles()
    footer = pq.ParquetFile(path.removeprefix("file:")).metadata
    groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24
    assert max(g.total_byte_size for g in groups) < 8 << 20


def test_phrases_are_dealt_before_they_are_summed(spark):
    rows = spark.createDataFrame([("en", "a b", 3), ("en", "a b", 4), ("de", "a b", 6), ("en", "b c", 7)], "lang string, phrase string, n long")
    found = collocations.summed(rows, 7)
    assert sorted(map(tuple, found.collect())) == [("en", "a b", 7), ("en", "b c", 7)]
    plan = found._jdf.queryExecution().sparkPlan().toString()  # without what is put in for the sum, above its first half
    assert "Exchange" in plan
    assert "HashAggregate" not in plan[plan.index("Exchange") :]


@pytest.mark.parametrize("phrases", [[], ["a"], ["a", "ü b", "c"]])
def test_a_slice_comes_back_as_it_was(phrases):
    row = collocations.relation_row("en", pa.array(phrases, pa.string()), np.array([0, 1, 0], dtype=np.int32))
    ((lang, found, places),) = collocations.slices_of([row, row.slice(0, 0)])
    assert (lang, found.to_pylist(), places.tolist()) == ("en", phrases, [0, 1, 0])


def test_collocations_of_an_empty_table(spark, frame):
    _, docs = frame([(1, "x")])
    assert collocations.mine(docs.limit(0)).count() == 0


def test_counts_beyond_64_bit_products(spark):
    one = spark.createDataFrame([("en", "a", 3 * 10**12), ("en", "b", 2 * 10**12)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", 10**12)], "lang string, phrase string, n long")
    assert [tuple(r) for r in collocations.scored([one, two], 2).collect()] == [("en", "a b", 10**12, 3 * 10**12, 2 * 10**12, 166666)]
