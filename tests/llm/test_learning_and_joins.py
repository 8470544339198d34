"""Language identification, similarity join, toxicity, surrogates and the pipeline against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import chosen_path, common, language, surrogates, toxicity


def all_cuts(word, prob):
    """Sum over all segmentations, by recursion; ``prob`` of a piece, or None."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = prob(word[:k], k)
        if p is not None:
            total += p * all_cuts(word[k:], prob)
    return total


def test_forward_sums_all_segmentations():
    path = language.default_path()
    pieces = language.vocabulary(path)
    rng = np.random.default_rng(1)
    p = rng.random(pieces.size)
    p /= p.sum()
    number = {n: i for i, n in enumerate(pieces.names)}

    def prob(piece, k):
        i = number.get(piece)
        return p[i] if i else (p[0] if k == 1 else None)

    words = ["the", "nation", "über", "日本", "x", "qzxj", "información"]
    model = language.LanguageModel(["l"], np.zeros(1), np.vstack([p[:, None], [[0.0]]]), path)
    got = model.log_probs(words)[:, 0]
    assert np.allclose(got, [math.log(all_cuts("▁" + w, prob)) for w in words], rtol=1e-9)
    # expected counts: the derivative of the log-sum, by finite differences
    for at, codes in language.by_length(words):
        found = pieces.matches(codes)
        counts = language.expected(found, model.prob, np.ones(len(at)))
        for i in np.flatnonzero(counts)[:4]:
            up = model.prob.copy()
            up[i] *= 1 + 1e-6
            slope = (np.log(language.forward(found, up)[:, -1]).sum() - np.log(language.forward(found, model.prob)[:, -1]).sum()) / 1e-6
            assert abs(slope - counts[i]) < 1e-3


def test_language_held_out_accuracy(spark, sf):
    docs = common.documents(spark, sf)
    held = common.hold_out("doc_id", 3, 1)
    model = language.train(docs.where(~held), rounds=2)
    rows = language.predict(docs, model).where(held).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, frame, odd):
    _, docs = frame([*odd, (9, "123 ²² --"), (10, "a" * 5000)])
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).where("doc_id > 1").collect()}
    assert [got[i].lang_pred for i in (2, 3, 9)] == ["und"] * 3 and got[10].lang_pred in ("en", "de", "fr")
    empty = frame([], "none")[1]
    assert language.predict(docs, language.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.predict(empty, model).count() == 0


def brute_links(texts):
    sets = {}
    for t in texts:
        words = (t or "").lower().split()
        n = min(5, len(words))
        sets[t] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
    return sets


def make_near(rnd):
    vocabulary = [f"v{i}" for i in range(2000)]
    rows, n = [], 0
    for _ in range(30):
        base = rnd.choices(vocabulary, k=rnd.randint(4, 120))
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("bucket,block", [(512, 256), (4, 3)])
def test_similarity_classes_equal_brute_force(spark, frame, odd, bucket, block):
    rows = make_near(random.Random(7)) + [(1000 + r[0], r[1]) for r in odd if r[0] is not None]
    _, docs = frame(rows)
    got = {}
    for r in chosen_path.similarity_classes(docs, bucket=bucket, block=block).collect():
        got.setdefault(r.id.doc_id, []).append(r)
    sets = brute_links([t for _, t in rows])
    key = [sets[t] for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(key):
        texts, links = set(), 0
        for j, b in enumerate(key):
            alike = a == b or (a | b and len(a & b) / len(a | b) >= 0.8 - 1e-9)
            if i != j and alike:
                links += 1
                texts |= {b} if b != a else set()
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for r in got[rows[i][0]]:
            assert (r.text_links, r.links) == (len(texts), links), rows[i]
    for i, row in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        assert got[row[0]][0].class_id.doc_id == min(members)


def test_similarity_of_null_ids_and_empty_tables(spark, frame, odd):
    _, docs = frame(odd)
    assert chosen_path.similarity_classes(docs.withColumn("tokens", F.lit(1))).count() == len(odd)
    _, docs = frame([], "none")
    assert chosen_path.similarity_classes(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(50))


def toxic_table(rnd):
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = rnd.choices(words, k=rnd.randint(5, 60))
        kind = rnd.random()
        if kind < 0.1:
            text[rnd.randrange(len(text))] = rnd.choice(["idiot", "scum", "pathetic", "worthless"])
        elif kind < 0.25:
            text[rnd.randrange(len(text))] = "zorb" + rnd.choice(["a", "en", "ith", "oma", "ul"])
        toxic = int(kind < 0.25) if rnd.random() > 0.03 else int(rnd.random() < 0.5)
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels, {d[0] for d in docs if re.search("idiot|scum|pathetic|worthless|zorb", d[1])}


def test_toxicity_learns_words_no_lexicon_has(spark, frame):
    rows, labels, truth = toxic_table(random.Random(2))
    _, docs = frame(rows)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.id: r.score for r in toxicity.score(docs, given, ~common.hold_out("doc_id", 5, 0)).collect()}
    wrong = [i for i in got if (got[i] >= 0.5) != (i in truth)]
    assert len(got) == len(rows) and len(wrong) <= 0.01 * len(rows), wrong


def test_a_toxic_text_of_many_copies_hides_no_word(spark, frame):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    long = " ".join("".join(rnd.choices("klmnopqrst", k=8)) for _ in range(1500))
    texts = [(0, rnd.choices(words, k=20)) for _ in range(500)] + [(1, [*rnd.choices(words, k=12), "zorba"]) for _ in range(45)]
    rows = [(i, " ".join(rnd.sample(t, len(t))), y) for i, (y, t) in enumerate(texts)] + [(1000 + i, long, 1) for i in range(400)]
    _, docs = frame([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, toxic int")
    assert toxicity.learned_units(docs, labels, "doc_id", "text", 20_000) == ["zorba$"]


def test_every_word_over_the_thresholds_is_learned(spark, frame):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["".join(x) for x in itertools.islice(itertools.product("klmnopqrst", repeat=3), 600)]
    rows = [(i, " ".join(rnd.choices(words, k=20)), 0) for i in range(1800)]
    rows += [(2000 + i, " ".join([*rnd.choices(words, k=5), *rnd.sample(bad, 150)]), 1) for i in range(200)]
    _, docs = frame([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, toxic int")
    assert set(toxicity.learned_units(docs, labels, "doc_id", "text", 20_000)) == {w + "$" for w in bad}


def test_toxicity_of_odd_rows(spark, frame, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for name, rows in (("odd", odd), ("none", [])):
        _, docs = frame(rows, name)
        got = toxicity.score(docs.withColumn("votes", F.lit(1)), none, ~common.hold_out("doc_id", 5, 0)).collect()
        assert len(got) == len(rows) and all(0 <= r.score < 0.5 for r in got)


KEY = b"key"


def test_surrogates_keep_form_and_stay_distinct():
    for kind, entity in (("email", "Bosb.42@mail8.example.com"), ("phone", "+1 (988) 555-2485"), ("card", "4539 1488 0343 6467"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ip", "42.144.35.254"), ("ssn", "123-45-6789")):
        new = surrogates.formed_surrogate(KEY, kind, entity)
        assert [x[2:] for x in surrogates.found(f"x {new} y")] == [(kind, new)] and new != entity
        if kind != "ip":
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", new)) == re.sub(r"\d", "0", re.sub("[a-z]", "a", entity)) or kind == "iban"
    assert surrogates.luhn(surrogates.formed_surrogate(KEY, "card", "4539148803436467"))
    for size in (2, 7, 1000):
        assert sorted(surrogates.permuted(KEY, "t", i, size) for i in range(size)) == list(range(size))


SCRIPTS = {"latin": ("abcdefghijklmnopqrstuvwxyz", "éüß"), "cyrillic": ("абвгдежзийклмнопрстуфхц", "іў"), "greek": ("αβγδεζηθικλμνξοπρστ", "άί")}


@pytest.mark.parametrize("pool", [f"{k}-{s}" for s in SCRIPTS for k in ("surname", "given")])
def test_names_are_told_apart_and_never_stay(pool):
    """All words of up to three letters, longer and odd ones: as many surrogates as names, each of the name's form."""
    kind, script = pool.split("-")
    usual, rarer = SCRIPTS[script]
    short = ["".join(c) for k in (1, 2) for c in itertools.product(usual + rarer, repeat=k)] + ["".join(c) for c in itertools.product(usual, repeat=3)]
    rng = random.Random(4)
    long = ["".join(rng.choices(usual + rarer, k=rng.randint(4, 20))) for _ in range(3000)]
    odd = [f"{a.title()}{j}{b.title()}" for a, b in zip(long[:300], long[300:600], strict=True) for j in ("-", "'", "")] + ["Ab漢c", "Ab漢d"]
    known = [n for n in surrogates.GENDER if surrogates.script_of(n) == script]
    names = {n[0].upper() + n[1:] if len(n[0].upper()) == 1 else n for n in short + long} | set(odd) | set(known)
    for gender in ("f", "m") if kind == "given" else ("",):
        new = {n: surrogates.name_surrogate(KEY, f"{pool}-{gender}".rstrip("-"), n) for n in names}
        assert len(set(new.values())) == len(names)
        for n, m in new.items():
            assert n != m and n[0].isupper() == m[0].isupper() and re.sub(r"\w", "", n) == re.sub(r"\w", "", m)
        if kind == "given":
            mine = {n for n in known if surrogates.GENDER[n] == gender}
            assert {new[n] for n in mine} == mine and not mine & {m for n, m in new.items() if n not in mine}


def test_syllables_tell_numbers_apart():
    for (script, gender), _ in surrogates.ENDS.items():
        words = [surrogates.spelled(script, gender, r, i) for r in range(3) for i in range(20000)]
        assert len(set(words)) == len(words)


def test_surrogates_of_a_growing_table_stay(spark, frame):
    texts = ["Mr. Hughes called", "Ms. Maria Hughes", "Anna Miller's dog met Mrs. Miller", "Anna Miller’s dog", "Dr. O'Brien and Mr. McDonald", "Mr. James Q"]
    _, small = frame([(i, t) for i, t in enumerate(texts)], "small")
    _, large = frame([(i, t) for i, t in enumerate(texts)] + [(100 + i, f"Herr {chr(65 + i % 26)}{chr(97 + i // 26)}mann") for i in range(400)], "large")
    before = {r.doc_id: r.text for r in surrogates.replace(small, KEY).collect()}
    after = {r.doc_id: r.text for r in surrogates.replace(large, KEY).collect()}
    assert before == {i: after[i] for i in before} and len(set(after.values())) == len(after)
    for i, leak in ((0, "Hughes"), (1, "Hughes"), (1, "Maria"), (2, "Miller"), (3, "Miller"), (4, "Brien"), (4, "Donald"), (5, "James")):
        assert leak not in before[i]
    hughes = before[0].split()[1]
    assert before[1].endswith(f" {hughes}")
    given, family = re.fullmatch(r"(\w+) (\w+)'s dog met Mrs\. (\2)", before[2]).groups()[:2]
    assert before[3] == f"{given} {family}’s dog" and re.fullmatch(r"Dr\. \w+'\w+ and Mr\. \w+", before[4])
    assert "Exchange" not in surrogates.replace(large, KEY)._jdf.queryExecution().executedPlan().toString()
    assert surrogates.collisions(large, KEY).count() == 0


@pytest.mark.parametrize(
    "number",
    "+49 30 1234567|+33 6 12 34 56 78|+44 20 7946 0958|+34 912 34 56 78|06 12 34 56 78|030 1234567|06.12.34.56.78|030/1234567|(030) 1234567|+49 (0)30 1234567|"
    "0049 30 1234|020 7946 0958|912 34 56 78|612 345 678|0612345678|+49 151 23456789|+4915123456789|+1 (988) 555-2485|988-555-2485".split("|"),
)
def test_telephone_numbers_of_several_countries(number):
    assert [x[2:] for x in surrogates.found(f"Tel {number}, bis 5")] == [("phone", number)]
    new = surrogates.formed_surrogate(KEY, "phone", number)
    assert new != number and [x[2:] for x in surrogates.found(f"Tel {new}, bis 5")] == [("phone", new)]
    assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", number)


def test_what_is_no_telephone_number():
    for text in ("am 01.02.2024 10 Uhr", "2024-05-06", "09.30-10.30", "05 06 07 08", "3.1415926", "+5 Punkte", "1 000 000", "v01.2"):
        assert surrogates.found(text) == [], text
    assert [x[3] for x in surrogates.found("+49 30 1234567 030 7654321")] == ["+49 30 1234567", "030 7654321"]
    assert [x[3] for x in surrogates.found("06 12 34 56 78 06 12 34 56 79")] == ["06 12 34 56 78", "06 12 34 56 79"]


@pytest.mark.parametrize(
    "text,name",
    [("gestern Hans Mueller da", "Hans Mueller"), ("con Juan Garcia aquí", "Juan Garcia"), ("Dr. Xaver Huber", "Xaver Huber"), ("Herr Prof. Dr. Huber kam", "Huber"), ("avec Jean-Pierre Dupont", "Jean-Pierre Dupont"), ("met Mary Jane Smith", "Mary Jane Smith")],
)
def test_names_beyond_the_pools(text, name):
    assert [x[3] for x in surrogates.found(text)] == [name]
    assert len(surrogates.GENDER) > 8 * sum(map(len, surrogates.GIVEN.values()))


def test_surrogates_in_documents(spark, frame, odd):
    text = "Mr. John Smith wrote to Anna Lindqvist; Mr. Smith (a.b@c.org, +1 (988) 555-2485) answered A.B@c.org. Госпожа Анна Петрова."
    names = [(100 + i, f"Frau {chr(65 + i % 26)}{'abcdefghij'[i // 26]}son") for i in range(200)]
    rows = [*odd, (50, text), (51, "Again Mr. Smith, a.b@c.org."), *names]
    _, docs = frame(rows)
    got = surrogates.replace(docs.withColumn("kinds", F.lit(0)), KEY)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities", "kinds"]
    out = {r.doc_id: r for r in got.collect()}
    first, second = out[50].text, out[51].text
    for leak in ("Smith", "Lindqvist", "a.b@c.org", "555-2485", "Петрова"):
        assert leak not in first and leak not in second
    surname = re.search(r"Mr\. (\w+) ([\w-]+) wrote", first)[2]
    assert f"Mr. {surname} (" in first and f"Mr. {surname}," in second
    assert re.search(r"Mr\. (\w+)", first)[1] in [n for n, g in surrogates.GENDER.items() if g == "m"] and surrogates.GENDER[re.search(r"to ([\w]+) ", first)[1]] == "f"
    assert re.search(r"[\w.]+@[\w.]+", first)[0] == re.search(r"[\w.]+@\w+\.\w+", second)[0]
    assert len({out[i].text for i, _ in names}) == 200
    assert out[4].text == odd[-1][1] and out[2].text == "" and got.count() == len(rows)
    assert surrogates.collisions(docs, KEY).count() == 0
    assert surrogates.replace(frame([], "none")[1], KEY).count() == 0


def test_pipeline_stages(spark, frame):
    rows = make_near(random.Random(9))
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in rows] + [(900, "123 456", "en", "a"), (901, None, None, None)]
    rows += [(910, rows[0][1].upper(), "en", "a")]
    _, docs = frame(rows)
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.saved(stage(spark, kept, ""), "test-stage")
        assert kept.columns == docs.columns
        seen[name] = kept.select("doc_id", "text").collect()
    assert {900, 901} & {r.doc_id for r in seen["language"]} == set()
    assert len({r.text.lower() for r in seen["exact_dedup"]}) == len(seen["exact_dedup"]) == len({r.text.lower() for r in seen["language"]})
    sets = brute_links([r.text for r in seen["near_dedup"]])
    values = list(sets.values())
    assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(values) for b in values[:i])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert packed.agg(F.countDistinct("doc_id")).collect()[0][0] == len({r.doc_id for r in seen["mix"]})
