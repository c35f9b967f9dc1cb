"""The general problems' operators on small hand-made inputs: brute force, edge cases, skew."""

import json
import random

import pyspark.sql.functions as F
import pytest

from millrace.functions.clean import clean_user, epoch_ms, instant_ms, plain
from millrace.operators.changes import apply_to, replay_changes
from millrace.operators.drift import canonical, catalogue, consistent_table, file_fields, flood, schema_changes, to_type
from millrace.operators.nested import contained, label, nested_nodes, node_table
from millrace.operators.sessions import sessions
from millrace.session import scratch_dir
from millrace.streaming.features import counters, feature_rows, run_counters
from millrace.streaming.sessions import merge_intervals, session_stream


def test_times(spark):
    rows = [("2018-01-08T01:02:03.456Z", 1515373323456), ("2018-01-08 01:02:03.456", 1515373323456), ("2018-01-08T03:02:03.456+02:00", 1515373323456), ("2018-01-08T03:02:03+0200", 1515373323000), ("2018-01-08T01:02", 1515373320000),
            ("20180108T010203Z", 1515373323000), ("1515373323456", 1515373323456), ("2018-01-08", 1515369600000), ("2018-02-30T00:00:00Z", None), ("NaN", None), ("", None), (None, None), ("2018-01-08T01:02:03,5z", 1515373323500)]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in spark.createDataFrame(rows, "t string, want bigint").select(instant_ms("t")).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [w for _, w in rows]


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("\x00a\x7fb\n", " Plain "), ("\x01", "  "), (None, None)], "u string, p string")
    assert [tuple(r) for r in df.select(clean_user("u"), plain("p")).collect()] == [("ab", "plain"), (None, None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(1515373323,), (1515373323000,), (None,)], "t bigint").select(epoch_ms("t")).collect()] == [1515373323000, 1515373323000, None]


def brute_sessions(rows, gap):
    out = []
    for user in {u for u, t, _ in rows if u is not None and t is not None}:
        own = sorted(((t, m) for u, t, m in rows if u == user and t is not None), key=lambda x: x[0])
        part = [own[0]]
        for x in [*own[1:], (float("inf"), None)]:
            if x[0] - part[-1][0] > gap:
                out.append((user, part[0][0], part[-1][0], part[-1][0] - part[0][0], len(part), len({m for _, m in part if m is not None})))
                part = []
            part.append(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_sessions(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *[rng.randrange(-500, 3000)] * 9]), rng.choice([None, *"mnopq"])) for _ in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "u string, t bigint, m string, start_ms int")
    got = sorted(tuple(r) for r in sessions(df, "u", "t", 20, "m").collect())
    assert got == brute_sessions(rows, 20)
    assert sorted(tuple(r)[:5] for r in sessions(df, "u", "t", 20).collect()) == [r[:5] for r in brute_sessions(rows, 20)]


def test_sessions_edges(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1800000), ("a", 3600001)], "u string, t bigint")
    assert sorted((r.start_ms, r.end_ms) for r in sessions(df, "u", "t").collect()) == [(0, 1800000), (3600001, 3600001)]
    assert sessions(df.limit(0), "u", "t", message=F.lit("x")).count() == 0


def test_session_stream(spark, tmp_path):
    parts = [[("a", 0), ("a", 10), ("b", 5)], [("a", 100), ("a", 55)], [("c", 400)], [("c", 1000)]]
    for i, p in enumerate(parts):
        spark.createDataFrame([(u, 1000 + t) for u, t in p], "u string, s bigint").selectExpr("u", "timestamp_seconds(s) AS at").coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema("u string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = []
    session_stream(stream, "u", "at", 50_000, "100 seconds").writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    # the late event at 55 joins what lay apart; what the watermark has not passed stays open
    assert sorted(got) == [("a", 1_000_000, 1_100_000, 4), ("b", 1_005_000, 1_005_000, 1), ("c", 1_400_000, 1_400_000, 1)]
    assert merge_intervals([(0, 5, 1), (20, 25, 1)], [(10, 15, 2)], 5) == [(0, 25, 4)]


CHANGES = "k string, t bigint, s bigint, op string, a string, b int"


def test_replay(spark):
    rows = [("x", 1, 1, "i", "p", 1), ("x", 3, 3, "u", None, 3), ("x", 2, 2, "u", "q", None), ("x", 2, 2, "u", "q", None), ("y", 1, 4, "i", "z", 9), ("y", 2, 5, "d", None, None), ("z", 1, 7, "d", None, None), ("z", 1, 8, "u", "new", None),
            (None, 1, 9, "i", "n", 1), ("w", None, 9, "i", "n", 1), ("v", 1, 1, "x", "n", 1), ("y2", 2, 2, "d", None, None), ("y2", 1, 1, "i", "late", 1)]
    df = spark.createDataFrame(rows, CHANGES)
    for run_rows in (1, 100):
        part = sorted(map(tuple, replay_changes(df, "k", "t", "s", "op", ["a", "b"], partial=True, run_rows=run_rows).collect()))
        assert part == [("x", 3, 3, "q", 3), ("z", 1, 8, "new", None)]
        whole = sorted(map(tuple, replay_changes(df, "k", "t", "s", "op", ["a", "b"], partial=False, run_rows=run_rows).collect()))
        assert whole == [("x", 3, 3, None, 3), ("z", 1, 8, "new", None)]
    assert replay_changes(df.limit(0), "k", "t", "s", "op", ["a"]).count() == 0


def test_replay_in_pieces(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 4 + list("abc")), rng.randrange(50), i, rng.choice("iuud"), rng.choice("pqr"), i) for i in range(200)]
    df = spark.createDataFrame(rows, CHANGES)
    whole = sorted(map(tuple, replay_changes(df, "k", "t", "s", "op", ["a", "b"], partial=False, run_rows=7).collect()))
    want = {}
    for k, t, s, op, a, b in sorted(rows, key=lambda r: r[1:3]):
        want[k] = None if op == "d" else (k, t, s, a, b)
    assert whole == sorted(v for v in want.values() if v)
    first = replay_changes(df.filter("s < 90"), "k", "t", "s", "op", ["a", "b"], partial=False, tombstones=True)
    again = apply_to(first, df, "k", "t", "s", "op", ["a", "b"])  # the first 90 are skipped as applied before
    assert sorted(tuple(r[c] for c in ("k", "t", "s", "a", "b")) for r in again.filter("op <> 'd'").collect()) == whole


def brute_nodes(record, lone):
    out = []

    def walk(value, node, kind, parent):
        for name, v in value.items():
            visit(v, f"{node}.{name}" if node else name, f"{kind}.{name}" if kind else name, parent)

    def visit(v, path, kind, parent):
        if isinstance(v, str) and v.strip().startswith("["):
            try:
                v = json.loads(v)
            except ValueError:
                return
        if isinstance(v, dict) and kind in lone:
            v = [v]
        if isinstance(v, dict):
            walk(v, path, kind, parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    out.append((f"{path}[{i}]", parent))
                    walk(x, f"{path}[{i}]", f"{kind}[]", f"{path}[{i}]")
                else:
                    visit(x, f"{path}[{i}]", f"{kind}[]", parent)

    walk(record, "", "", "")
    return out


NESTED = [
    {"a": [{"b": [{"c": 1}, None, {}]}, {"b": '[{"x": 2}]'}], "m": {"n": [{"z": 1}]}},
    {"a": {"b": {"c": 2}}, "s": "[broken", "k": [[{"deep": 1}], 5, "x"], "dotted.key": [{"q": 1}]},
    {}, {"e": [], "f": None, "a": "[]"},
]


def test_nested(spark):
    rows = [(f"m{i}", json.dumps(r)) for i, r in enumerate(NESTED)] + [("m0", json.dumps(NESTED[0])), ("bad", '{"a": [{'), ("list", "[1]"), ("none", None), ("blank", ""), (None, '{"a": [{}]}')]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id string, p string, node int")
    for limit in (1000, 0):  # as a constant, and joined by path
        nodes = nested_nodes(df, "id", "p", lone_limit=limit)
        got = sorted((r.message or "", r.node, r.parent) for r in nodes.filter("in_array").collect())
        want = sorted((f"m{i}", n, p) for i, r in enumerate(NESTED) for n, p in brute_nodes(r, {"a", "a[].b"})) + [("", "a[0]", "")]
        assert got == sorted(want)
    assert sorted(map(tuple, node_table(nested_nodes(df, "id", "p"), "a[].b[]", {"c": "int", "x": "int"}).filter("message <> ''").select("message", "node", "parent", "place", "c", "x").collect())) == [
        ("m0", "a[0].b[0]", "a[0]", 0, 1, None), ("m0", "a[0].b[2]", "a[0]", 2, None, None), ("m0", "a[1].b[0]", "a[1]", 0, None, 2), ("m1", "a[0].b[0]", "a[0]", 0, 2, None)]
    assert nested_nodes(df.limit(0), "id", "p").count() == 0


def test_labels():
    nodes = label(NESTED[0], {"a"})
    by = {n[0]: n for n in nodes}
    for n in nodes:
        for m in nodes:
            inside = m[0] != n[0] and (n[0] == "" or m[0].startswith((n[0] + ".", n[0] + "[")))
            assert inside == (n[4] < m[4] and m[5] < n[5])
    assert contained(nodes)[[n[0] for n in nodes].index("a[0].b[0]")] == "a[0]" and "m" in by
    deep = {}
    at = deep
    for _ in range(50_000):
        at["x"] = {}
        at = at["x"]
    assert len(label(deep, set())) == 50_001


def drifting():
    users = [f"u{i}" for i in range(12)]
    files = []
    for f in range(4):
        for i, u in enumerate(users):
            p = {"id" if f < 2 else "identifier": f"v{i}", "n": i if f < 1 else str(i), "o": {"x": i % 3}, "extra" if f == 2 else "base": f * 100 + i, f"k{f}_{i}": 1, "maybe": None if i % 2 else True}
            files.append((f"f{f}", u, f * 1000 + i, json.dumps(p)))
    return files


def test_schema_changes(spark):
    df = spark.createDataFrame([*drifting(), ("f1", "u1", 1, "broken"), (None, "u1", 1, "{}"), ("f9", "u1", 1, None)], "file string, u string, ms bigint, p string")
    got = sorted(map(tuple, schema_changes(df, "file", "p", "u", "ms").collect()))
    assert got == [("f1", "retyped", "n", "n"), ("f2", "added", "", "extra"), ("f2", "removed", "base", ""), ("f2", "renamed", "id", "identifier"), ("f3", "added", "", "base"), ("f3", "removed", "extra", "")]
    exact, rough = (sorted(map(tuple, file_fields(df.repartition(7), "file", "p", s).collect())) for s in (0.0, 0.5))  # 0.5 leaves fields open at first
    assert exact == rough
    assert ("f0", "maybe", "boolean", 6, 12) in exact
    assert schema_changes(df.limit(0), "file", "p", "u", "ms").count() == 0


def test_consistent_table(spark):
    df = spark.createDataFrame(drifting(), "file string, u string, ms bigint, p string")
    fields = file_fields(df, "file", "p")
    column, kinds = catalogue(fields, schema_changes(df, "file", "p", "u", "ms", fields))
    assert column["id"] == column["identifier"] == "identifier"
    rows = consistent_table(df, "file", "p", ["u"], column, kinds).orderBy("file", "u").collect()
    assert len(rows) == 48 and {r.properties__identifier for r in rows if r.u == "u3"} == {"v3"}
    assert all(r.other[f"k{r.file[1]}_{r.u[1:]}"] == "1" for r in rows)  # nothing is lost
    assert (canonical(2.0), canonical("2.0"), canonical(True), canonical("Yes"), canonical(" X ")) == ("2", "2", "1", "1", "x")
    assert (to_type("7.5", "number"), to_type("no", "boolean"), to_type("x", "number"), to_type([1], "array"), to_type(3, "string")) == (7.5, False, None, "[1]", "3")


def test_flood():
    bs, as_, s = flood({"user": "object", "user.name": "string", "n": "number"}, {"person": "object", "person.name": "string", "n": "number"}, {})
    assert s[bs.index("user")].argmax() == as_.index("person") and s[bs.index("user.name")].argmax() == as_.index("person.name")


FEATURES = {"event": "e", "os": "o"}


def test_features(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 4 + ["a", "b", None]), rng.choice([None, *range(20)]), rng.choice([None, *[f"m{i}" for i in range(60)]]), rng.choice(["x", "y", "", None]), rng.choice(["l", None]), rng.choice([1, None])) for _ in range(300)]
    rows = list({r[2]: r for r in rows if r[2]}.values()) * 2 + [r for r in rows if not r[2]]
    df = spark.createDataFrame(rows, "u string, t bigint, id string, e string, o string, n int")
    want = {}
    seen = set()
    for u, t, i, e, o, n in rows:
        if u is None or t is None or (key := i or (u, t, e, o, n)) in seen:
            continue
        seen.add(key)
        for f, v in (("*", ""), ("event", e), ("os", o)):
            if v or f == "*":
                c = want.setdefault((u, f, v), [0, -1, 0])
                want[(u, f, v)] = [c[0] + 1, max(c[1], t), c[2] + (n or 0)]
    want = sorted((*k, *v) for k, v in want.items())
    assert sorted(map(tuple, counters(df, "u", "t", "id", FEATURES, ["n"]).toDF("entity", "field", "val", "n1", "last", "n2").collect())) == want
    df.withColumnRenamed("n", "total").repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u string, t bigint, id string, e string, o string, total int").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    at = scratch_dir(spark)
    out = run_counters(stream, at, "u", "t", "id", FEATURES, ["total"], rows_each_batch=True)
    assert sorted(map(tuple, out.collect())) == want
    wide = {r.entity: r for r in feature_rows(out, ["total"]).collect()}
    assert wide["hot"].event["x"].n == next(w[3] for w in want if w[:3] == ("hot", "event", "x"))
    last = spark.read.parquet(f"{at}/rows").groupBy("entity").agg(F.max_by("n", "batch").alias("n")).collect()
    assert {r.entity: r.n for r in last} == {r.entity: r.n for r in wide.values()}


def test_array_text_after_blanks():
    record = {"a": " \n" * 100 + '[{"b": 1}]', "c": " " * 100 + "no array"}
    assert [n[0] for n in label(record, set())] == ["", "a[0]"]


def test_renames_come_from_flooding(monkeypatch):
    """Constant leaves say nothing by name or value; only what flooding carries over from their siblings tells them apart."""
    import pandas as pd

    from millrace.operators import drift

    before = {"a": "object", "a.id": "string", "a.k": "number", "b": "object", "b.id": "string", "b.k": "number", "n": "number"}
    after = {"x": "object", "x.id": "string", "x.k": "number", "y": "object", "y.id": "string", "y.k": "number", "n": "number"}
    rows = [("p", f, before.get(f), after.get(f), None, None, None, None, None) for f in sorted(before | after)]
    for g in ("a", "b"):
        for c in ("x", "y"):
            rows.append(("p", None, None, None, f"{g}.k", f"{c}.k", 9, 9, 1.0))
            rows.append(("p", None, None, None, f"{g}.id", f"{c}.id", 9, 9 if (g, c) in (("a", "y"), ("b", "x")) else 0, 0.1))
    pdf = pd.DataFrame(rows, columns=["pair", "path", "before", "after", "gone", "come", "users", "same", "chance"])
    want = {("a.id", "y.id"), ("a.k", "y.k"), ("b.id", "x.id"), ("b.k", "x.k")}
    assert {(r.gone, r.come) for r in drift.select_renames(pdf).itertuples()} == want

    def by_name(b, a, evidence, **_):
        bs, as_ = sorted(b), sorted(a)
        return bs, as_, drift.np.array([[drift.name_likeness(x, y) for y in as_] for x in bs])

    monkeypatch.setattr(drift, "flood", by_name)
    assert {(r.gone, r.come) for r in drift.select_renames(pdf).itertuples()} != want


@pytest.mark.parametrize("run_rows", [10, 100_000])
def test_replay_with_a_hot_key(spark, run_rows):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 30}", rng.randrange(50), i, rng.choice("iiud"), rng.choice([None, "p", "q"]), i) for i in range(2000)]
    state = {}
    for k, t, s, op, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
        if op == "d":
            state.pop(k, None)
        else:
            old = state.get(k, (0, 0, None, None))
            state[k] = (t, s, a if a is not None else old[2], b)
    got = replay_changes(spark.createDataFrame(rows * 2, CHANGES), "k", "t", "s", "op", ["a", "b"], run_rows=run_rows)
    assert sorted(map(tuple, got.collect())) == sorted((k, *v) for k, v in state.items())


def test_one_traversal_for_each_message(spark):
    """Deliveries that differ: labels come from one of them, a readable one, and nest."""
    rows = [("m", '{"a": [{"x": 1}, {"y": 2}]}'), ("m", '{"a": [{"b": [{"z": 1}]}], "c": {"d": 1}}'), ("m", '{"a": [{'), ("m", None)]
    for some in (rows, rows[::-1], rows[1:3]):
        nodes = [(r.node, r.pre, r.post) for r in nested_nodes(spark.createDataFrame(some, "id string, p string"), "id", "p").collect()]
        assert sorted(n for n, _, _ in nodes) in (["", "a[0]", "a[1]"], ["", "a[0]", "a[0].b[0]", "c"])
        assert sorted(p for _, p, _ in nodes) == sorted(q for _, _, q in nodes) == list(range(len(nodes)))


def test_sessions_of_a_table(spark, tmp_path):
    """The state under a watermark closes all sessions of a table, however late its files bring their rows."""
    from millrace.streaming.sessions import run_sessions

    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *[rng.randrange(-500, 3000)] * 9]), None) for _ in range(300)]
    spark.createDataFrame([r[:2] for r in rows], "u string, t bigint").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u string, t bigint").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    got = run_sessions(stream, scratch_dir(spark), "u", "t", 20)
    assert sorted((r.u, r.start_ms, r.end_ms, r.end_ms - r.start_ms, r.events) for r in got.collect()) == [r[:5] for r in brute_sessions(rows, 20)]
