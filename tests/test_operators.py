"""Reference operators that SQL twins don't cover: feeds, records, sinks, streams, scorers, texts."""

import base64
import contextlib
import datetime
import gzip
import io
import json
import math
import random
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from compare import differences, duck
from pyspark.sql import Row

from millrace import pipeline as P
from millrace.functions import aggregates as A
from millrace.functions import payload as Y
from millrace.functions import scores as S
from millrace.functions import text as X
from millrace.operators import nearest
from millrace.operators import retrieval as R
from millrace.operators.enrich import prefix_join
from millrace.operators.induction import induce_types
from millrace.operators.merges import merge_vocabulary
from millrace.operators.ranks import at_positions, cumulative_counts
from millrace.operators.rollup import advance_rollup
from millrace.plans import corpus
from millrace.sources import records as I
from millrace.sources import sinks as K
from millrace.streaming import pipes as V


def ints(spark, n=4):
    return spark.range(n).select(F.col("id").alias("x"))


def test_feeds(spark):
    src = P.source("ints", lambda s: ints(s))
    total = P.sum_of("sum", [], total=F.col("x"))
    assert P.Pipeline().chain(src, total).run(spark)["sum"].first().total == 6
    twice = P.flat_map("twice", "y", F.array(F.lit(1), F.lit(2)))
    run = P.Pipeline().chain(src, twice, total).run(spark)
    assert run["sum"].first().total == 12
    other = P.sum_of("other", [], total=F.col("x"))
    run = P.Pipeline().chain(src, twice).fan_out(twice, total, other).run(spark)
    assert run["sum"].first().total == run["other"].first().total == 12
    some = P.source("some", lambda s: ints(s), only=("x", [1, 3]))
    run = P.Pipeline().chain(some, total).run(spark)
    assert run["sum"].first().total == 4
    assert run.errors("some").collect() == [Row(reason="filtered out", n=2)]
    assert run.error_sample("some", 1).count() == 1
    odd = P.check("odd", F.when(F.col("x") % 2 == 1, "odd"))
    seen = []
    run = P.Pipeline().chain(src, P.keep("positive", F.col("x") > 0), odd, P.one_to_one("half", h=F.when(F.col("x") > 0, F.col("x") / 2)), P.written("sink", lambda df: seen.append(df.count()))).run(spark)
    assert run.errors("odd").first().n == 2 and [r.h for r in run["half"].collect()] == [1.0] and seen == [1]


def test_feed_rules(spark):
    src, total = P.source("a", lambda s: ints(s)), P.sum_of("a", [], total=F.col("x"))
    for wrong in (P.Pipeline().chain(src, total), P.Pipeline().chain(P.keep("k", F.lit(True)), P.keep("l", F.lit(True))), P.Pipeline().chain(src, P.sum_of("s", [], t=F.col("x")), P.keep("m", F.lit(True)))):
        with pytest.raises(ValueError):
            wrong.run(spark)


def test_key_values(spark, tmp_path):
    rows = spark.createDataFrame([(" k1 ", "v1", 7), ("k2", "", -1), ("k1", "w", 7)], "k string, v string, t int")
    K_ = f"{tmp_path}/kv"
    I.write_kv(rows, K_, "k", "v", "t")
    assert sorted((r.key, r.tag, bytes(r.value)) for r in I.read_kv(spark, K_, tagged=True).collect()) == [("k1", 7, b"v1"), ("k1", 7, b"w"), ("k2", -1, b"")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x").write_text(f"a\t{base64.urlsafe_b64encode(zlib.compress(b'ok')).decode()}\nb\tnothing\nc\n")
    assert {r.key: r.value and bytes(r.value) for r in I.read_kv(spark, f"{tmp_path}/bad").collect()} == {"a": b"ok", "b": None, "c": None}


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event": "a", "n": 1}\n{"event": "b", "n": 2}\nbroken\n{"event": "a", "n": "x"}\n')
    ev = I.read_events(spark, f"{tmp_path}/e.json", "event string, n int")
    assert ev.filter("_corrupt IS NOT NULL").count() >= 1 and I.read_events(spark, f"{tmp_path}/e.json", "event string, n int", names=["b"]).first().n == 2
    with pytest.raises(I.DecodeBudget):
        I.read_events(spark, f"{tmp_path}/e.json", "event string, n int", max_errors=0)
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n,true\n')
    c = I.read_csv(spark, f"{tmp_path}/c.csv")
    assert [tuple(r) for r in c.select(I.inferred(F.col("a")), I.inferred(F.col("b"))).collect()] == [("int", "string"), (None, "boolean")]
    kinds = spark.createDataFrame([("1.5",), ("2018-01-08T01:02:03Z",), ("-3",), ("NaN",)], "s string")
    assert [r[0] for r in kinds.select(I.inferred(F.col("s"))).collect()] == ["float", "time", "int", "string"]


def test_files(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, body in (("r/a.py", b"import os"), ("r/b.bin", b"0" * 50)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "x.tar.gz").write_bytes(buf.getvalue())
    (tmp_path / "y.tar.gz").write_bytes(b"no archive")
    got = sorted((r.name or "", r.size, r.contents) for r in I.read_archives(spark, str(tmp_path), endings=(".py",)).collect())
    assert got == [("", None, None), ("r/a.py", 9, "import os"), ("r/b.bin", 50, None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/t.txt").write_text("two\nlines")
    assert [r.text for r in I.read_files(spark, f"{tmp_path}/d", (".txt",)).collect()] == ["two\nlines"]
    assert I.prefixes(datetime.date(2018, 1, 8), datetime.date(2018, 1, 8), 12, late_hours=1) == ["2018/01/08/00", "2018/01/08/12", "2018/01/09/00"]
    assert I.repeated(ints(spark), 3).count() == 12 and I.repeated(ints(spark), 0).count() == 0
    assert sorted(r.x for r in I.shuffled(ints(spark, 20), 3).collect()) == list(range(20)) != [r.x for r in I.shuffled(ints(spark, 20), 3).collect()]


def test_sinks(spark, tmp_path):
    assert len(K.write_rolled(ints(spark, 10).coalesce(1), f"{tmp_path}/r", 4)) >= 3
    K.write_partitioned(ints(spark).withColumn("h", F.col("x") % 2), f"{tmp_path}/p", "h")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["h=0", "h=1"]
    snap = K.Snapshot(spark, f"{tmp_path}/s")
    assert snap.read() is None
    put = K.upsert_into(snap, "id", "t")
    rows = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("a", 2, "z"), ("a", 0, "old")]]
    for i, r in enumerate(rows):
        put(spark.createDataFrame(r, "id string, t int, v string"), i)
    assert sorted(map(tuple, snap.read().select("id", "t", "v").collect())) == [("a", 2, "z"), ("b", 1, "y")] and len(snap.versions()) == 3
    assert spark.createDataFrame([("u", 3)], "a string, b int").select(K.document_id("a", "b")).first()[0] == __import__("hashlib").md5(b"u::3").hexdigest()
    sent = K.deliver(ints(spark, 10), "x", 4, 3, lambda part: None).agg(F.sum("rows")).first()[0]
    assert sent == 6
    K.log_run(spark, f"{tmp_path}/runs", "job", {"a": 1}, {"n": 2})
    K.log_run(spark, f"{tmp_path}/runs", "job2", {}, {})
    assert [r.name for r in K.runs(spark, f"{tmp_path}/runs").collect()] == ["job2", "job"]


def test_streams(spark, tmp_path):
    for i, r in enumerate([[("a", 0, 1), ("a", 0, 1), ("b", 30, 2)], [("a", 70, 3)], [("a", 5000, 4)], [("z", 9000, 1)]]):
        spark.createDataFrame([(u, 10_000 + t, v) for u, t, v in r], "id string, s bigint, v int").selectExpr("id", "timestamp_seconds(s) AS at", "v").coalesce(1).write.json(f"{tmp_path}/in/{i}")
    streams = V.routed(spark, f"{tmp_path}/in", "id string, at timestamp, v int", {"all": "*.json", "none": "*.csv"}, files_per_batch=1)
    got, sums = [], []
    V.run_available(V.once_within(streams["all"], "at", "10 minutes", "id", "v"), f"{tmp_path}/c1", V.fork(lambda df, _: got.extend(map(tuple, df.select("id", "v").collect()))))
    assert sorted(got) == [("a", 1), ("a", 3), ("a", 4), ("b", 2), ("z", 1)]
    V.run_available(V.tumbling(streams["all"], "at", "1 minute", "10 minutes", ["id"], F.sum("v").alias("v")), f"{tmp_path}/c2", lambda df, _: sums.extend((r.id, r.v) for r in df.collect()))
    assert ("a", 2) in sums and ("b", 2) in sums
    state = {}
    V.run_available(V.latest_state(streams["all"], "id", "v", "at"), f"{tmp_path}/c3", lambda df, _: state.update({r.id: r.v for r in df.collect()}), "update")
    assert state == {"a": 4, "b": 2, "z": 1}


def test_texts(spark):
    df = spark.createDataFrame([("how to check if a script", "alpha beta GAMMA(Delta_Epsilon, phi) zeta zALPHA", "see I/O, `x`s a/b [c] snake_case.")], "a string, b string, c string")
    w = F.split("a", " ")
    assert [len(df.select(X.ngrams(w, n)).first()[0]) for n in (1, 2, 3, 7)] == [6, 5, 4, 0]
    with pytest.raises(ValueError):
        X.ngrams(w, 0)
    sh = df.select(X.shingles(F.col("b")), X.shingles(F.col("b"), keep_underscores=True)).first()
    assert sorted(sh[0]) == sorted(["alpha", "alpha", "gamma", "delta", "epsil", "psilo", "silon", "zalph", "eltae", "ltaep", "taeps", "aepsi"])
    assert set(sh[0]) - set(sh[1]) == {"eltae", "ltaep", "taeps", "aepsi"}
    assert df.select(X.normalise(F.col("c"))).first()[0].split() == ["see", "I/O", "x", "a", "b", "c", "snake_case"]
    assert df.select(X.split_names(F.lit("getFileName_raw"))).first()[0] == ["get", "file", "name", "raw"]
    assert [X.porter_stem(x) for x in ("caresses", "ponies", "cats", "feed", "agreed", "plastered", "motoring", "sing", "conflated", "hopping", "falling", "happy", "relational", "rational", "formaliti", "hopefulness", "electrical", "adjustment", "adoption", "probate", "cease", "controll")] == ["caress", "poni", "cat", "feed", "agre", "plaster", "motor", "sing", "conflat", "hop", "fall", "happi", "relat", "ration", "formal", "hope", "electr", "adjust", "adopt", "probat", "ceas", "control"]
    assert df.select(X.stems(F.array(F.lit("cats"), F.lit("cats")))).first()[0] == ["cat", "cat"]
    assert df.select(X.top_level_imports(F.lit("import os.path\nfrom a.b import c\nimport os\n#import no\n"))).first()[0] == ["a", "os"]
    assert df.select(X.html_words(F.lit("<p>A &lt;b&gt; <script>x</script>c</p>"))).first()[0] == ["a", "b", "c"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, ["hello", "worlld"]), (2, ["golang", "or", "c", "which", "one", "is", "better", "is"]), (3, ["is", "going", "is", "is", "worlld"])], "d int, t array<string>")
    c = R.term_counts(docs, "d", "t")
    w = {r.term: r.idf for r in R.idf(c, "d", 3).collect()}
    assert w["worlld"] == pytest.approx(math.log10(1.5)) and w["is"] == pytest.approx(math.log10(1.5)) and w["hello"] == pytest.approx(math.log10(3))
    assert {r.term for r in R.probabilistic_idf(c, "d", 3).collect()}.isdisjoint({"worlld", "is"})
    t = R.tf(c, "d").filter("d = 3 AND term = 'is'").first()
    assert (t.tf, t.tf_short) == (0.6, 1.0)
    n = R.normalised(spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, s double"), ["g"], "s").orderBy("g", "s").collect()
    assert [r.z for r in n] == [-1.0, 1.0, 0.0] and [r.part for r in n] == [0.25, 0.75, 1.0] and n[0].softmax == pytest.approx(1 / (1 + math.e**2))


@contextlib.contextmanager
def spark_conf(spark, key, value):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _written(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_similar_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(3, 9))) for _ in range(300)] + ["straße_größe", "𝒜𝒷𝒸𝒹𝑒𝒻", "日本語日本語文書"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(700)]
    rows += [(i + 1000, rows[i][1]) for i in range(0, 300, 7)] + [(100, "abcde once more"), (151, rows[150][1]), (151, "x"), (None, rows[50][1]), (None, "abcdeabcde"), (50_000, None), (50_050, "Ω"), (50_100, "a" * 3000)]
    folder, sql = _written(spark, tmp_path, rows), corpus.SQL["similar_documents"]
    con = duck(folder)
    assert differences(corpus.similar_documents(spark, folder), con, sql) == ""
    monkeypatch.setattr(nearest, "QUERY_ENTRIES", 300)  # several parts of queries, and blocks
    monkeypatch.setattr(nearest, "BLOCK_DOCUMENTS", 1)
    with spark_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "90"):
        assert differences(corpus.similar_documents(spark, folder), con, sql) == ""
    monkeypatch.setattr(corpus, "LISTED_TERMS", 3)  # joined instead
    assert differences(corpus.similar_documents(spark, folder), con, sql) == ""


@pytest.mark.parametrize("common, tile", [(0, 3), (5, 3), (40, 7), (512, 256)])
def test_best_of_blocks(monkeypatch, common, tile):
    monkeypatch.setattr(nearest, "COMMON", common)
    monkeypatch.setattr(nearest, "TILE", tile)
    rng = np.random.default_rng(5)
    held = rng.random((200, 40)) * (rng.random((200, 40)) < np.linspace(0.01, 0.6, 40))
    held[150:] = held[:50]
    norm = np.sqrt((held**2).sum(1))
    asked = held[::10] / 3
    q = nearest.Queries(np.arange(0, 200, 10), *np.nonzero(asked), asked[asked > 0], np.full(20, -1.0), 40)
    top = nearest.Best(q, 5)
    for a in (0, 70):
        part = held[a : a + 70] if not a else held[a:]
        top.offer(np.arange(a, a + len(part)), *np.nonzero(part), part[part > 0], norm[a : a + len(part)])
    score = np.floor(asked @ held.T / np.maximum(norm, 1e-9) * 1e5 + 0.5) / 1e5
    want = []
    for i, x in enumerate(score):
        others = [d for d in range(200) if d != 10 * i and (asked[i] * held[d]).any()]
        want += [(10 * i, d, x[d]) for d in sorted(others, key=lambda d: (-x[d], d))[:5]]
    got = [(r["query"], r["doc"], r["score"]) for r in top.rows().to_pylist()]
    assert got == want


def test_windows_of_words():
    w = nearest.Windows(["bcdef"])
    row, term, c = w.entries(pa.array([["abcdef", "bcdefbcdef"], [], ["abcdef"]]))
    assert (row.tolist(), term.tolist(), c.tolist()) == ([0] * 6 + [2] * 2, [0, 1, 2, 3, 4, 5, 0, 1], [3, 1, 1, 1, 1, 1, 1, 1])


def test_similar_documents_shuffles_no_pairs(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    folder = _written(spark, tmp_path, [(i, " ".join(rng.choices(words, k=12))) for i in range(5000)])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert corpus.similar_documents(spark, folder).count() == 500
    assert written() - before < 1_000_000  # of the 500,000 pairs nearly all share a term


def test_cursor_mix(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", 2), (2, "a", 5), (3, None, 1)], "d int, t string, at int")
    got = {r.d: r.near and [tuple(x) for x in r.near] for r in R.near_cursor(df, "d", "t", "at", 2).collect()}
    assert got == {1: [("a", 1), ("b", 2), ("c", 1)], 2: None, 3: None}
    v = lambda rows: R.unit_vectors(spark.createDataFrame(rows, "d int, term string, w double"), "d", "w")
    out = {r.term: (round(r.w, 6), round(r.norm, 6)) for r in R.mixed_vectors(v([(1, "x", 3.0), (1, "y", 4.0)]), v([(1, "y", 5.0)]), "d", 0.25).collect()}
    assert out == {"x": (0.45, round((0.45**2 + 0.85**2) ** 0.5, 6)), "y": (0.85, round((0.45**2 + 0.85**2) ** 0.5, 6))}


def test_ranks(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)] + [(None,)], "v double")
    s = sorted(i % 7 for i in range(100))
    assert [r.v for r in at_positions(df, "v", [0.0, 0.5, 0.9, 1.0]).orderBy("nth").collect()] == [s[0], s[50], s[90], s[99]]
    assert cumulative_counts(df.limit(0), "v").count() == 0 and at_positions(df.limit(0), "v", [0.5]).count() == 0
    got = df.agg(A.nearest_rank(F.col("v"), 0.5)).first()[0]
    assert got == s[50] and df.filter("v > 99").agg(A.nearest_rank(F.col("v"), 0.5)).first()[0] is None


def test_rollup_and_joins(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, n bigint, last string")
    out = advance_rollup(mk([("a", 5, "x"), ("b", 2, "y")]), mk([("a", 1, None), ("c", 3, "z")]), mk([("b", 2, "y"), ("a", 1, "q")]), "k", ["n"], ["last"])
    assert sorted(map(tuple, out.collect())) == [("a", 5, "x"), ("b", 0, "y"), ("c", 3, "z")]
    ips = spark.createDataFrame([("1.2.3.4",), ("10.0.0.9",), ("bad",), (None,), ("1.2.3.999",)], "ip string").withColumn("n", A.ipv4_number(F.col("ip")))
    assert [r.n for r in ips.collect()] == [16909060, 167772169, None, None, None]
    blocks = spark.createDataFrame([(167772160, 8, "big"), (167772160, 24, "small"), (0, 0, "all")], "base bigint, bits int, name string")
    assert {r.ip: r.name for r in prefix_join(ips, "n", blocks, "base", "bits", ["name"]).collect()} == {"1.2.3.4": "all", "10.0.0.9": "small", "bad": None, None: None, "1.2.3.999": None}
    assert prefix_join(ips, "n", blocks.limit(0), "base", "bits", ["name"]).filter("name IS NULL").count() == 5


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0, ["a", "b"], ["b", "c"], [])], "x double, y double, p array<string>, q array<string>, e array<string>")
    f = S.scaled(["x", "y"], [1.0, 0.0], [0.5, 1.0])
    t = {"feature": 1, "at": 1.5, "below": {"value": 1}, "above": {"feature": 0, "at": 2.0, "below": {"value": 5}, "above": {"value": 9}}}
    r = df.select(S.linear(f, [2.0, 3.0], 1.0).alias("l"), S.radial(f, [([1.0, 2.0], 4.0)], 0.5).alias("r"), S.ensemble(f, [t, t]).alias("t"), S.precision_recall(F.col("p"), F.col("q")).alias("p"), S.precision_recall(F.col("e"), F.col("q")).alias("z"), *[F.round(S.logistic(F.lit(z)), 4).alias(f"g{i}") for i, z in enumerate((0.0, -2.0, 6.0))]).first()
    assert (r.l, r.r, r.t, tuple(r.p), tuple(r.z), (r.g0, r.g1, r.g2)) == (9.0, 4.0, 10.0, (0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.5, 0.1192, 0.9975))
    g = df.select(A.argmax_name(["x", "y"])).first()[0]
    assert g == "y"


def test_payloads(spark):
    packed = base64.b64encode(gzip.compress(json.dumps([{"a": 1}, 2]).encode())).decode()
    df = spark.createDataFrame([(packed, '{"$a": null, "b": {"c": null, "$d": [null, {"e": null}]}}', "Ab@X.io"), ("zz", "x", "a@b"), (None, None, None)], "b string, j string, m string")
    rows = df.select(Y.unpack_list("b"), Y.scrubbed("j"), Y.valid_email(F.col("m"), ["io"])).collect()
    assert [tuple(r) for r in rows] == [(['{"a": 1}', "2"], '{"b":{"d":[null,{}]}}', True), (None, None, False), (None, None, False)]
    assert Y.match_gain("nums", [], "nums = sorted(set(n", "ums))") == 3
    assert Y.match_gain("foo(, )", [(4, 4)], "fo", "o(1, )") == 5
    assert spark.createDataFrame([("abc", "x = a", "bc")], "c string, b string, a string").select(Y.completion_gain("c", "b", "a")).first()[0] == 2


def test_merges(spark):
    words = spark.createDataFrame([("aaab", 3), ("aab", 2), ("b", 9), ("", 5)], "w string, n bigint")
    assert merge_vocabulary(words, "w", "n", 9) == [("a", "a"), ("a", "b"), ("aa", "ab")] or merge_vocabulary(words, "w", "n", 2)[0] == ("a", "a")
    assert merge_vocabulary(words.limit(0), "w", "n", 3) == []


def test_induction(spark):
    samples = spark.createDataFrame([(i, "open" if i % 2 else "dial", ["read", "write"] if i % 2 else ["send"]) for i in range(20)] + [(99, "open", [])], "var int, func string, attrs array<string>")
    types = spark.createDataFrame([("file", "read"), ("file", "write"), ("socket", "send"), ("socket", "read"), ("socket", "write")], "type string, attr string")
    p, attrs, losses = induce_types(samples, types, 4)
    by = {(r.func, r.type): r.p for r in p.collect()}
    assert by[("open", "file")] > 0.8 and by[("dial", "socket")] == pytest.approx(1.0) and losses[-1] < losses[0]
    assert all(abs(r.s - 1) < 1e-6 for r in attrs.groupBy("type").agg(F.sum("p").alias("s")).collect())


def test_ratios(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", None, 0), ("a", False, None), ("b", None, None)], "k string, b boolean, n int")
    got = {r.k: (r.r, r.c) for r in df.groupBy("k").agg(A.ratio_true(F.col("b")).alias("r"), A.count_positive(F.col("n")).alias("c")).collect()}
    assert got == {"a": (0.5, 1), "b": (None, None)}
    assert spark.createDataFrame([(0,), (1,), (1,), (3,)], "w int").agg(A.streak(F.col("w"))).first()[0] == 2
