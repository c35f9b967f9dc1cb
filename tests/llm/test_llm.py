"""The training-data operators on small hand-made inputs: brute force, edge cases, skew, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from millrace.llm import mixing, packing, sketch, subjects, terms, tokens
from millrace.llm.queries import _bare
from millrace.tables import load

FOLDER = "/root/testdata/sf0.01"


def brute_grams(docs, longest):
    total, records = Counter(), {}
    for d, ws in docs:
        for n in range(1, longest + 1):
            for i in range(len(ws) - n + 1):
                g = tuple(ws[i : i + n])
                total[g] += 1
                records.setdefault(g, set())
                if d is not None:
                    records[g].add(d)
    return sorted((g, total[g], len(records[g])) for g in total)


@pytest.mark.parametrize("task_rows", [3, 1000])
def test_term_frequencies(spark, task_rows):
    rng = random.Random(2)
    docs = [(d if d % 9 else None, [rng.choice(["the"] * 6 + ["a\x00b", "x\x01", "é", "zz"]) for _ in range(rng.randrange(12))]) for d in range(40)]
    rows = [(ws[i : i + 3], d, 1) for d, ws in docs for i in range(len(ws))]
    df = spark.createDataFrame([*rows, ([], 1, 1), (None, 1, 1), (["a", None], 1, 1)], "s array<string>, r bigint, n int")
    got = sorted((tuple(r.terms), r.total, r.records) for r in terms.term_frequencies(df, "s", "r", "n", task_rows).collect())
    assert got == brute_grams(docs, 3)
    assert terms.term_frequencies(df.limit(0), "s", "r", "n").count() == 0


def test_value_frequencies(spark):
    rows = [("hot", i % 50) for i in range(200)] + [("rare", 1), ("rare", 2), ("rare", 2), ("lost", None), ("", 3), (None, 60), *[("mid", i) for i in range(3)]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "v string, r bigint, rows int")
    for task_rows in (7, 10_000):
        got = {r.v: (r.rows, r.records, r.mark) for r in terms.value_frequencies(df.drop("rows"), "v", "r", task_rows=task_rows).collect()}
        assert got == {"hot": (200, 50, "common"), "rare": (3, 2, "rare"), "lost": (1, 0, "rare"), "mid": (3, 3, "common")}


def test_ngrams(spark):
    docs = [(1, "The cat, the CAT"), (2, None), (3, "  "), (4, "cat"), (None, "the cat")]
    got = {r.ngram: (r.n, r.rows, r.records) for r in terms.ngram_frequencies(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", 2).collect()}
    assert got == {"the": (1, 3, 1), "cat": (1, 4, 2), "the cat": (2, 3, 1), "cat the": (2, 1, 1)}


def test_bare_tags(spark):
    df = spark.createDataFrame([(" <Python> ",), ("< C++ >",), ("<>",), (" \t",), (None,), ("a<b>",), ("<x",)], "t string")
    assert [r[0] for r in df.select(_bare(F.col("t"))).collect()] == ["python", "c++", None, None, None, "a<b>", "<x"]


def test_sketch_accuracy(spark):
    sizes = {"none": 0, "one": 1, "ten": 10, "k": 1000, "big": 200_000}
    rows = spark.range(400_000).select((F.col("id") % 200_000).cast("string").alias("u"), F.explode(F.array(*[F.lit(g) for g in sizes])).alias("g"))
    limit = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(n))])[F.col("g")]
    kept = rows.filter(F.col("u").cast("bigint") < limit)
    parts = [sketch.bit_matrices(kept.filter(F.col("u").cast("int") % 3 == i), ["g"], "u") for i in range(3)]
    merged = sketch.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[0]), ["g"])
    for df in (merged, sketch.bit_matrices(kept, ["g"], "u")):
        got = {r.g: (r.estimate, r.std_error) for r in sketch.estimate(df, ["g"]).collect()}
        assert set(got) == set(sizes) - {"none"}
        for g, (est, err) in got.items():
            assert abs(est - sizes[g]) <= max(4 * err, 0.6) and err <= max(0.013 * sizes[g], 0.5)


def test_estimator_bounds():
    rng = np.random.default_rng(1)
    n, rows, errors = 30_000, 1024, []
    for _ in range(40):
        cells, ranks = rng.integers(0, rows, n), rng.geometric(0.5, n) - 1
        bits = np.zeros((rows, sketch.RANKS), bool)
        bits[cells, np.minimum(ranks, sketch.RANKS - 1)] = True
        est, err = sketch.likelihood_estimate(bits.sum(0)[None, :], rows)
        errors.append((est[0] - n) / err[0])
    assert 0.6 < np.std(errors) < 1.5 and abs(np.mean(errors)) < 0.6


def test_distinct_counts_cube(spark):
    df = spark.createDataFrame([("d1", "x", "u1"), ("d1", "x", "u1"), ("d1", None, "u2"), ("d2", "x", "u1"), ("d2", "x", None)], "d string, c string, u string")
    got = {(r.level, r.d, r.c): round(r.estimate) for r in sketch.distinct_counts(df, ["d", "c"], "u").collect()}
    assert got == {(0, "d1", "x"): 1, (0, "d1", None): 1, (0, "d2", "x"): 1, (1, "d1", None): 2, (1, "d2", None): 1, (2, None, "x"): 1, (2, None, None): 1, (3, None, None): 2}
    assert sketch.distinct_counts(df.limit(0), ["d", "c"], "u").count() == 0


def test_doubled(spark):
    rows = [(day, "A", f"u{i}") for day, n in ((1, 30), (2, 60), (3, 119), (4, 240)) for i in range(n)] + [(1, "B", "x"), (3, "B", "x"), (3, "B", "y"), (2, None, "x"), (None, "A", "x"), (4, "C", None)]
    df = spark.createDataFrame([(f"2018-01-0{d}" if d else None, g, u) for d, g, u in rows * 2], "d string, g string, u string").withColumn("d", F.to_date("d"))
    got = sorted((str(r.d), r.g, r.members, r.members_before) for r in sketch.doubled(df, "d", "g", "u").collect())
    assert got == [("2018-01-02", "A", 60, 30), ("2018-01-04", "A", 240, 119)]


def test_packing(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([1, 7, 50, 260, 260, 511, 512, 513, 1024, 5000])) for i in range(3000)] + [(None, 5), (1, None), (2, 0)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id bigint, tokens int, container string")
    kinds = spark.createDataFrame([("a", 512), ("b", 2048), ("bad", 0), (None, 9)], "kind string, capacity int")
    rows = packing.pack(df, kinds, island=300).collect()
    good = [(i, t) for i, t in sizes if i is not None and t]
    for kind, cap in (("a", 512), ("b", 2048)):
        own = [r for r in rows if r.kind == kind]
        fill, pieces = Counter(), {}
        for r in own:
            fill[r.container] += r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(t for _, t in good)
        for i, t in good:
            if t <= cap:
                assert pieces[i] == [(0, t)]
            else:
                assert sorted(p for p, _ in pieces[i]) == list(range(len(pieces[i]))) and sum(x for _, x in pieces[i]) == t and sum(x < cap for _, x in pieces[i]) <= 1
        assert len(fill) <= 1.03 * packing.ceil(sum(t for _, t in good) / cap) or kind == "a"
    assert packing.pack(df.limit(0), kinds).count() == 0 and packing.pack(df, kinds.limit(0)).count() == 0


def test_evolution():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    packed = packing.evolve(sizes, 100, seed=1)
    assert sorted(x for c in packed for x in c) == list(range(200)) and all(sum(sizes[x] for x in c) <= 100 for c in packed)
    first: list = []
    packing.best_fit(list(range(200)), sizes, 100, first, [])
    assert len(packed) <= len(first)
    # three items fill a container only in the right company: best fit alone needs more
    hard = [44, 33, 23] * 20
    assert len(packing.evolve(hard, 100, seed=2)) <= 21
    child = packing.crossover(first, packed, sizes, 100, rng)
    assert sorted(x for c in child for x in c) == list(range(200))
    assert sorted(x for c in packing.mutate(first, sizes, 100, rng) for x in c) == list(range(200))
    assert packing.evolve([], 10, 1) == [] and packing.evolve([10] * 7, 10, 1) == [[i] for i in range(7)]


def test_tokens():
    assert tokens.count_tokens(["hello world", "", " \n", None, "<|endoftext|>", "x" * 20_000])[:4] == [2, None, None, None]
    assert tokens.count_tokens(["<|endoftext|>"])[0] > 1


def test_raking():
    cells = [((s, t), 10.0 * (i + 1)) for i, (s, t) in enumerate((s, t) for s in "ab" for t in "xyz")]
    x = mixing.rake(cells, [1e9] * 6, [{"a": 100, "b": 50}, {"x": 60, "y": 50, "z": 40}])
    assert x[:3].sum() == pytest.approx(100) and x[3:].sum() == pytest.approx(50) and x[[0, 3]].sum() == pytest.approx(60, rel=1e-4)
    capped = mixing.rake(cells, [20.0] * 6, [{"a": 50, "b": 60}, {"x": 60, "y": 50, "z": 0}])
    assert capped.max() <= 20 + 1e-9 and capped[3:].sum() == pytest.approx(60)
    assert mixing.spread(np.array([1.0, 2.0, 3.0]), np.array([1.0, 9.0, 9.0]), 11.0).tolist() == pytest.approx([1, 4, 6])


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "other"]), rng.choice(["en", "de"]), rng.choice(["t1", "t2", "none"]), rng.randrange(5, 400)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens int")
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2), (None, 0.1, 1), ("other", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets)
    rep = {r.source: r for r in mixing.share_report(got, targets).collect()}
    assert abs(rep["big"].actual_share - 0.5) < 0.001 and rep["big"].most_copies == 1 and rep["small"].most_copies == 3 and rep["absent"].tokens == 0
    small = sum(r[4] for r in rows if r[1] == "small")
    assert rep["small"].tokens == 3 * small  # the scarcest source is used up
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_units():
    text = "First sentence. Second one!\n## Title\n```\ndef f(x):\n    # a remark\n    return x\n```\n\nimport a\nx = 1\n\n// only a remark\n"
    assert [len(u) for u in subjects.units(text)] == [1, 1, 2, 1, 1]
    assert subjects.readable("<p>a &quot;b&quot;</p><p>GrÃ¼n</p>\r\n﻿x") == 'a "b"\nGrün\nx'
    assert subjects.words("getInterestRate liability_id, Passes") == ["get", "interest", "rate", "liability", "id", "passe"]


def test_subjects(spark):
    ex = [(r.text, r.subject.strip().lower()) for r in load(spark, FOLDER, "subject_examples").collect()]
    docs = [(r.text, r.path) for r in load(spark, FOLDER, "documents").filter("text IS NOT NULL").collect()]
    held = ex[::5]
    model = subjects.fit([e for i, e in enumerate(ex) if i % 5], docs)
    found = subjects.classify_batch(model, subjects.Hasher(model.slots), [t for t, _ in held])
    right = sum(bool(f) and max(f, key=lambda s: (f[s], s)) == s for f, (_, s) in zip(found, held))
    assert right >= 0.88 * len(held)  # a few labels are wrong on purpose
    two = ["We grade every essay once. The tutor keeps a diploma for each exam. The oven needs butter and garlic.", "", None, "   "]
    out = subjects.classify_batch(model, subjects.Hasher(model.slots), two)
    assert out[0].get("education") == 2 and out[0].get("cooking") == 1 and out[1:] == [{}, {}, {}]
    df = spark.createDataFrame([(1, two[0]), (2, None), (3, " "), (None, two[0])], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.subject, r.units) for r in subjects.document_subjects(df, model).collect()) == [(0, "education", 2), (1, "education", 2)]
    nothing = subjects.fit([], docs[:20])
    assert subjects.classify_batch(nothing, subjects.Hasher(nothing.slots), two) == [{}] * 4
    long = " ".join(["the loader reads one exam per line and groups them by essay"] * 3_000)
    assert subjects.classify_batch(model, subjects.Hasher(model.slots), [long])[0].get("education", 0) > 1_000


def test_subjects_count_all_documents(spark):
    ex = load(spark, FOLDER, "subject_examples")
    tail = "x" * 20_000 + ". " + "Zorbly quixents marn every dolt. " * 40
    docs = load(spark, FOLDER, "documents").select("doc_id", "text", "path").union(spark.createDataFrame([(-1, tail, None)], "doc_id bigint, text string, path string"))
    texts = [r.text for r in docs.filter("text IS NOT NULL").collect()]
    model = subjects.fit_from(ex, docs, fit_documents=20)
    said = [r.text for r in ex.filter("trim(text) <> '' AND trim(subject) <> ''").collect()]
    assert model.openings == subjects.learn_openings(said + texts) and ("2", "zorbly", "quixents") in model.openings

    total, most, n = subjects.spread_of(docs)(model)
    hasher, counts = subjects.Hasher(model.slots), {}
    for t in texts:
        grams = [hasher.grams(part) for unit in subjects.text_units(t, model.openings) for part in unit]
        main = subjects._clear(model.scores(grams)).sum(0)
        for k in {k for g in grams for k in g if main.max() > 0}:
            counts.setdefault(k, Counter())[int(main.argmax())] += 1
    assert n == len(texts) and total[1:].max() > 20
    assert all((total[k], most[k]) == ((c := counts.get(k, Counter())).total(), max(c.values(), default=0)) for k in range(1, len(total)))
    whole = subjects.fit_from(ex, docs, fit_documents=10_000)
    local = subjects.fit(sorted((r.text, r.s) for r in ex.selectExpr("text", "lower(trim(subject)) AS s").filter("trim(text) <> '' AND s <> ''").collect()), [(r.text, r.path) for r in docs.filter("text IS NOT NULL").orderBy(F.xxhash64("doc_id")).collect()])
    assert whole.slots == local.slots and np.allclose(whole.weights, local.weights) and whole.openings == local.openings
