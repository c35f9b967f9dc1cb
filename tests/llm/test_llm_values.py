"""Results of the training-data queries without an SQL twin, against the tables they come from."""

import math

import pyarrow.parquet as pq
import pytest

from millrace.llm import subjects
from millrace.llm.queries import QUERIES, _active

FOLDER = "/root/testdata/sf0.01"


def test_estimates_hold_their_bounds(spark):
    rows = {(r.active_day and str(r.active_day), r.country_iso_code, r.os, r.userid) for r in _active(spark, FOLDER).collect()}
    members: dict = {}
    for d, c, o, u in rows:
        for level in range(8):
            key = level, *[None if level >> (2 - i) & 1 else v for i, v in enumerate((d, c, o))]
            members.setdefault(key, set()).add(u)
    got = {(r.level, r.active_day, r.country_iso_code, r.os): r for r in QUERIES["p6_counts"](spark, FOLDER).collect()}
    assert got.keys() == members.keys()
    outside = sum(not r.low - 0.6 <= len(members[k]) <= r.high + 0.6 for k, r in got.items())
    assert outside <= 0.01 * len(got)


def test_containers_are_full(spark):
    for r in QUERIES["p8_report"](spark, FOLDER).collect():
        assert r.least <= r.containers <= math.ceil(1.01 * r.least)


def test_shares_are_met(spark):
    targets = {r["source"]: r for r in pq.read_table(f"{FOLDER}/mix_targets.parquet").to_pylist()}
    got = {r.source: r for r in QUERIES["p9_shares"](spark, FOLDER).collect()}
    assert got.keys() == targets.keys()
    for s, r in got.items():
        assert r.actual_share == pytest.approx(targets[s]["target_share"], abs=0.001) and r.most_copies <= targets[s]["max_repeats"]


def test_rare_and_new_languages(spark):
    from millrace.llm import mixing

    rows = [(i, "a", "fr" if i % 4 else "it", "t", 10) for i in range(400)] + [(1000, "a", "zz", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens int")
    out = mixing.mix(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert {r.lang for r in out.select("lang").distinct().collect()} == {"fr", "it", "other"}


def test_gaps_are_closed_to_the_end(spark):
    from millrace.llm import mixing

    drawn = spark.createDataFrame([(i, "a", "x", "t", 2**i, 0, 1, i) for i in range(12)], "doc_id bigint, source string, lang string, topic string, tokens int, copies int, _most int, _h bigint")
    out = mixing._settle(drawn, {"a": 2.0**12 - 1})
    assert out.count() == 12  # each step takes the largest that fits: as many as there are


def test_arrays_read_as_texts_do():
    texts = ["First sentence here, is it. fix: Second one!\n## Title\n```\ndef getName(x):\n    # a remark on taxes\n    return x_9\n```\n", "one two three four five six seven eight nine ten eleven the loader reads one exam and the tutor keeps two essays", "9 8 7 6 5", "", None]
    model = subjects.fit([("the tutor grades one essay. the tutor reads an exam. every essay counts.", "education"), ("the loader reads a file. the build is green. a file is open.", "software")], [], openings=frozenset({("2", "the", "tutor"), ("2", "the", "loader")}))
    parsed = subjects.Parsed(subjects.Parser().parse(texts))
    _, _, z, _, _ = subjects.Reader(model).read(parsed)
    hasher = subjects.Hasher(model.slots)
    slow = model.scores([hasher.grams(part) for t in texts if t for unit in subjects.text_units(t, model.openings) for part in unit])
    assert z.shape == slow.shape and abs(z - slow).max() < 1e-4


def test_hot_terms_without_records(spark):
    from millrace.llm import terms

    rows = [("hot", None if i % 2 else i) for i in range(4000)] + [("cold", 1)]
    df = spark.createDataFrame(rows, "v string, r bigint").repartition(8)
    parts = df.selectExpr("array(v) AS s", "r", "1 AS n")
    got = {r.terms[0]: (r.total, r.records) for r in terms.term_frequencies(parts, "s", "r", "n", task_rows=100).collect()}
    assert got == {"hot": (4000, 2000), "cold": (1, 1)}
