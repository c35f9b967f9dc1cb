"""Feeds as round trips: tables go through a source, a pipe or a sink and come back. Operator ids of the survey in brackets."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import pipeline as P
from millrace.functions.payload import decoded_text, pack_list, unpack_list, valid_email
from millrace.session import cut, scratch_dir
from millrace.sources import records as I
from millrace.sources import sinks as K
from millrace.streaming import pipes as V
from millrace.tables import load

#: The event names that others are mapped to; unmapped ones are left out.
NAMES = {"purchase": "bought", "click": "touched", "view": "seen"}
ENDINGS = ["io", "com", "org"]


def key_value_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tagged key-value records, written, read back, and summed by shards in parallel [S3 S4 K3]."""
    at = scratch_dir(spark)
    I.write_kv(load(spark, folder, "orders"), at, "o_custkey", "o_orderpriority", "o_orderkey")
    read = I.read_kv(spark, at, tagged=True).select("key", F.col("tag").cast("bigint").alias("tag"), F.col("value").cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby(["key", "text"], as_index=False).agg(n=("tag", "size"), newest=("tag", "max"))

    parts = I.each_shard(read, 4, "key", count, "key string, text string, n bigint, newest bigint")
    return parts.groupBy("key", "text").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


def dataset_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a table, scanned as three disjoint shards, twice over [S1 S2 S12]."""
    at = scratch_dir(spark)
    rows = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows.repartition(7).write.parquet(at)
    shards = [I.read_dataset(spark, at, rows.schema.simpleString()[7:-1].replace(":", " "), shard=i, shards=3, epochs=2) for i in range(3)]
    every = shards[0].unionByName(shards[1]).unionByName(shards[2])
    return every.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def files_as_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Text files read as bytes and as texts: their sizes by the key they were written under [S6 S7]."""
    at = scratch_dir(spark)
    load(spark, folder, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("k")).repartition(1, "k").write.partitionBy("k").text(at)
    key = F.regexp_extract("path", r"/k=(\d+)/", 1).cast("bigint")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(at).groupBy(key.alias("key")).agg(F.sum("length").alias("bytes"))
    texts = I.read_files(spark, at, (".txt",)).groupBy(key.alias("key")).agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))
    return sizes.join(texts, "key")


def shuffled_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by (repository, language), each corpus in an order that a seed fixes [S8 X2]."""
    w = Window.partitionBy("repo", "lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return load(spark, folder, "documents").filter("repo IS NOT NULL AND lang IS NOT NULL").select("repo", "lang", "doc_id", F.row_number().over(w).alias("nth"))


def landed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event lines in landing folders of days, read by prototypes in two shards within a range, broken lines counted [S9 S10 S11 S13 R3]."""
    at = scratch_dir(spark)
    e = load(spark, folder, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), "user_id", "value")))
    e.select(line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day")).hint("rebalance", "day").write.partitionBy("day").text(f"{at}/raw")
    read = [I.read_event_range(spark, f"{at}/raw", datetime.date(2024, 1, 5), datetime.date(2024, 1, 20), {"purchase": "user_id bigint, value double", "": "user_id bigint"}, shard=i, shards=2) for i in range(2)]
    every = read[0].unionByName(read[1])
    user = F.get_json_object("body", "$.user_id").cast("bigint")
    worth = F.count(F.get_json_object("body", "$.value"))
    return every.groupBy("day", F.coalesce("event", F.lit("broken")).alias("event")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("users"), worth.alias("with_value"))


def tables_by_format(spark: SparkSession, folder: str) -> DataFrame:
    """One table written as Parquet, JSON lines and CSV, in folders, and read back from each [S14 K2 K6 K7]."""
    n = load(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    out = []
    for kind in ("parquet", "json", "csv"):
        at = scratch_dir(spark)
        if kind == "csv":
            n.write.option("header", True).csv(at)
            back = I.read_csv(spark, at).select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_regionkey").cast("bigint").alias("r"), F.col("n_name").alias("name"))
        else:
            K.write_partitioned(n, at, "n_regionkey", kind=kind)
            back = spark.read.schema(n.schema).format(kind).load(at).select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_regionkey").cast("bigint").alias("r"), F.col("n_name").alias("name"))
        out.append(back.withColumn("kind", F.lit(kind)))
    every = out[0].unionByName(out[1]).unionByName(out[2])
    return every.groupBy("kind", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"), F.min("name").alias("first"))


def exported_users(spark: SparkSession, folder: str) -> DataFrame:
    """Id, name and address of users, exported as CSV and read with a schema; whether the address is valid [S15 P22]."""
    at = scratch_dir(spark)
    c = load(spark, folder, "customer")
    mail = F.concat(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "."), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("@"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, ".IO").otherwise(".zz"))
    c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), mail.alias("email")).write.option("header", True).csv(at)
    return I.read_csv(spark, at, "id bigint, name string, email string").withColumn("valid", valid_email(F.col("email"), ENDINGS))


def routed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files routed by name to streams of their own, mapped, filtered and tapped [S16 R1 R2 P10 P13 P14 P15]."""
    at = scratch_dir(spark)
    e = load(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    for name, cond in (("bought", "event_type = 'purchase'"), ("other", "event_type <> 'purchase'")):
        e.filter(cond).write.json(f"{at}/in/{name}")
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    progress = []
    for name in ("bought", "other"):
        stream = V.routed(spark, f"{at}/in/{name}", schema, {name: "*.json"}, files_per_batch=2)[name]
        mapped = stream.select("event_id", "user_id", (F.col("value") * 2).alias("twice")).filter("twice > 2")
        progress.append((name, V.run_available(mapped, f"{at}/checkpoint/{name}", V.fork(K.append_to(f"{at}/out/{name}"), K.append_to(f"{at}/tap/{name}")))))
    rows = spark.createDataFrame([(n, sum(p["numInputRows"] for p in ps)) for n, ps in progress], "route string, read bigint")
    both = [spark.read.schema("event_id bigint, user_id bigint, twice double").parquet(f"{at}/{way}/{name}").select(F.lit(name).alias("route"), F.lit(way).alias("way"), "twice") for name in ("bought", "other") for way in ("out", "tap")]
    every = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    sums = every.groupBy("route").agg(F.count_if(F.col("way") == "out").alias("n"), F.count_if(F.col("way") == "tap").alias("tapped"), F.round(F.sum(F.when(F.col("way") == "out", F.col("twice"))), 2).alias("total"))
    return rows.join(sums, "route")


def index_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Two indexes merged into one with new blocks, then all values of the urgent orders looked up [S17 K12]."""
    at = scratch_dir(spark)
    li = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    I.build_index(li.filter("l_linenumber <= 2"), "l_orderkey", "l_partkey", f"{at}/a")
    I.build_index(li.filter("l_linenumber > 2"), "l_orderkey", "l_partkey", f"{at}/b")
    I.merge_indexes(spark, [f"{at}/a", f"{at}/b"], f"{at}/c", lambda v: F.array_sort(F.flatten(v)))
    found = I.look_up(spark, f"{at}/c", load(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'"), "o_orderkey")
    return found.select(F.col("key").alias("o_orderkey"), F.array_join("values", ",").alias("parts"))


def feed_sums(spark: SparkSession, folder: str) -> DataFrame:
    """A feed: a source with some keys let through, maps, filters, errors by reason, several aggregators [S1 S12 S18 P1 P2 P3 P5 P6 P7 P9 A1 A2 K5]."""
    src = P.source("orders", lambda s: load(s, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), only=("o_orderstatus", ["F", "O"]))
    half = P.one_to_one("half", half=F.when(F.col("o_totalprice") > 50_000, F.col("o_totalprice") / 2))
    known = P.check("known", F.when(F.col("o_orderpriority").startswith("4"), "not specified"))
    twice = P.flat_map("twice", "copy", F.array(F.lit(1), F.lit(2)))
    kept = P.keep("kept", F.col("half") < 200_000)
    sums = P.sum_of("sums", ["o_orderstatus"], n=F.lit(1), total=F.col("half"))
    urgent = P.sum_of("urgent", ["o_orderpriority"], n=F.lit(1), total=F.col("half"))
    run = P.Pipeline().chain(src, half, known, twice, kept).fan_out(kept, sums, urgent).run(spark)
    one = run["sums"].select(F.lit("sum").alias("what"), F.col("o_orderstatus").alias("name"), "n", F.round("total", 2).alias("total"))
    two = run["urgent"].select(F.lit("sum"), F.col("o_orderpriority"), "n", F.round("total", 2))
    bad = run.errors("orders").unionByName(run.errors("known")).select(F.lit("error"), "reason", "n", F.lit(None).cast("double"))
    out = cut(one.union(two).union(bad))
    run.release()
    return out


def error_sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """At most ten errors of each reason kept as a sample, a sampling operator: sizes, and errors in all [P8]."""
    reason = F.when(F.col("l_quantity") > 45, F.concat(F.lit("large "), F.col("l_returnflag"))).when(F.col("l_discount") > 0.09, "cheap")
    run = P.Pipeline().chain(P.source("lines", lambda s: load(s, folder, "lineitem")), P.check("checked", reason)).run(spark)
    sampled = run.error_sample("checked", 10).groupBy(F.col(P.ERROR).alias("reason")).agg(F.count(F.lit(1)).alias("sampled"))
    return run.errors("checked").join(sampled, "reason")


def event_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Events written in blocks of 10 per user, read from the newest to the oldest [K15 S19]."""
    at = scratch_dir(spark)
    I.write_blocks(load(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), at, ["user_id"], "ts", 10)
    return I.read_blocks(spark, at, ["user_id"]).select("user_id", "nth", "event_id", "event_type")


def rolled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written in files rolled by number and by bytes, good ones counted as they pass; what came back [K1 K4]."""
    at = scratch_dir(spark)
    o = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    seen = K.write_counted(o, f"{at}/counted", F.col("o_totalprice") > 10_000)
    K.write_rolled(o, f"{at}/rolled", 1_000, max_bytes=40_000)
    files = spark.read.schema("o_orderkey bigint").json(f"{at}/rolled").groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    back = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rolled"), F.coalesce(F.max("n") <= 1_000, F.lit(True)).alias("within"))
    return back.select(F.lit(seen["written"]).cast("bigint").alias("written"), F.lit(seen["errors"]).cast("bigint").alias("errors"), "rolled", "within")


def appended_days(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct active users appended day by day to a partitioned table, and what it then holds [K6 K8 A46]."""
    at = scratch_dir(spark)
    days = load(spark, folder, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    K.write_partitioned(days.filter("day < '2024-01-20'"), at, "day", mode="append")
    K.write_partitioned(days.filter("day >= '2024-01-20'"), at, "day", mode="append")
    return spark.read.schema("user_id bigint, day date").parquet(at).groupBy("day").agg(F.count(F.lit(1)).alias("users"))


def swapped_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Orders upserted into a snapshot that is swapped, old versions dropped; the newest of each customer [K9 K14 R4]."""
    snap = K.Snapshot(spark, scratch_dir(spark))
    put = K.upsert_into(snap, "o_custkey", "at")
    o = load(spark, folder, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderstatus")
    for i, cond in enumerate(("at.o_orderdate < '1995-01-01'", "at.o_orderdate >= '1995-01-01'", "at.o_orderdate >= '1997-01-01'")):
        put(o.filter(cond), i)
    gone = snap.drop_old()
    return snap.read().select("o_custkey", F.col("at.o_orderkey").alias("o_orderkey"), "o_orderstatus", F.lit(len(gone)).alias("dropped"))


def bulk_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """A day's summary per user upserted under ids made of its key, repeated and corrected, touched buckets only [K10 R4 X3]."""
    daily = load(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("version"))
    rows = cut(daily.select(K.document_id("user_id", "day").alias("id"), "user_id", "day", "n", "version"))
    store = K.KeyedStore(spark, scratch_dir(spark), "id", "version", "id string, user_id bigint, day date, n bigint, version bigint", buckets=8)
    store.upsert(rows.withColumn("n", F.lit(0).cast("bigint")).withColumn("version", F.col("version") - 1), 0)
    store.upsert(rows.filter("day >= '2024-01-10'"), 1)
    store.upsert(rows.filter("day < '2024-01-12'"), 2)
    return store.read(2).select("id", "user_id", "day", "n")


def resumed_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows delivered in batches of 100 from where the last delivery ended: batches' rows, none of them twice [K11 R5]."""
    sent = K.deliver(load(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 51, 100, lambda part: None)
    return sent.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("rows") <= 100, F.lit(True)).alias("within"))


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """A run with its parameters and the figures of each feed, logged and listed with the newest first [K13]."""
    at = scratch_dir(spark)
    sizes = {t: load(spark, folder, t).count() for t in ("nation", "region", "supplier")}
    K.log_run(spark, at, "first", {"tables": 2}, {"nation": sizes["nation"]})
    K.log_run(spark, at, "second", {"tables": 1}, sizes)
    w = Window.orderBy(F.desc("at"))  # one row per run
    return K.runs(spark, at).select(F.row_number().over(w).alias("nth"), "name", "status", "params", F.get_json_object("results", "$.nation").cast("bigint").alias("nations"))


def lazy_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut lazily into pieces of 500 characters, any number from each [P4 P3]."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                starts = range(0, len(text), 500)
                yield pd.DataFrame({"doc_id": doc, "piece": range(len(starts)), "chars": [min(500, len(text) - a) for a in starts]})

    feed = P.pieces("pieces", pieces, "doc_id bigint, piece int, chars int")
    src = P.source("texts", lambda s: load(s, folder, "documents").select("doc_id", "text").filter("text <> ''"))
    return P.Pipeline().chain(src, feed).run(spark)["pieces"]


def edited_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nested fields dropped, cast and set by their dotted path [P18]."""
    p = load(spark, folder, "mixpanel_people_raw").select("change_seq", F.col("properties").dropFields("plan", "editors").withField("windows_domain_membership", F.col("properties.windows_domain_membership").cast("int")).withField("os", F.lower("properties.os")).alias("p"))
    return p.select("change_seq", "p.*").distinct()


def unpacked_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists packed as gzip in base64, unpacked and exploded, each element under the message's id and its number [P19]."""
    m = load(spark, folder, "mixpanel_people_raw").filter("distinct_id IS NOT NULL AND size(properties.editors) > 0").select("change_seq", "distinct_id", F.col("properties.editors").alias("e")).distinct()
    packed = m.withColumn("blob", pack_list(F.transform("e", lambda x: F.to_json(F.struct(x.alias("editor"))))))
    each = packed.select("change_seq", "distinct_id", F.posexplode(unpack_list("blob")).alias("i", "j"))
    return each.select(F.concat_ws("-", "distinct_id", F.col("change_seq").cast("string"), (F.col("i") + 1).cast("string")).alias("id"), F.get_json_object("j", "$.editor").alias("editor"))


def mapped_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events under the names they are mapped to; others are left out [P29]."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return load(spark, folder, "events").select(F.to_date("ts").alias("day"), names[F.col("event_type")].alias("name")).filter("name IS NOT NULL").groupBy("day", "name").agg(F.count(F.lit(1)).alias("n"))


def path_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Files by the first rule that keeps them out of a corpus of code, or none [P27 P28 P31]."""
    d = load(spark, folder, "documents").select("path", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower("path")
    name = F.element_at(F.split("path", "/"), -1)
    rule = (
        F.when(F.col("path").isNull(), "no path").when(~name.contains("."), "no ending").when(F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) > 1, "several dots")
        .when(low.contains("/node_modules/"), "packages").when(low.rlike(r"(^|/)(vendor|godeps|site-packages)/") | low.rlike(r"bindata\.go$"), "vendored").when(~low.rlike(r"\.(py|go|js|java|ts|c|h|cpp|rb|md)$"), "other ending")
        .when(F.octet_length("text") > 50_000, "too large").when(F.lower("text").rlike(r"(?m)^\s*(#|//|/\*|\*).*generated by"), "generated").otherwise("kept")
    )
    return d.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("files"))


def decoded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in three encodings, told by marks or validity and brought to UTF-8: how many come back whole [T9]."""
    d = load(spark, folder, "documents").filter("text <> '' AND NOT startswith(text, '\\uFEFF')").select("doc_id", "text")
    d = d.filter(~F.col("text").rlike("[\\ud800-\\udfff]"))
    ways = {"utf-8": F.encode("text", "UTF-8"), "utf-16-be": F.encode("text", "UTF-16")}
    each = [d.select(F.lit(n).alias("wanted"), "text", decoded_text(raw).alias("got")) for n, raw in ways.items()]
    every = each[0].unionByName(each[1])
    return every.groupBy("wanted").agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("got.text") == F.col("text")) & (F.col("got.encoding") == F.col("wanted"))).alias("whole"), F.sum(F.length("got.text")).alias("chars"))


def udf_surface(spark: SparkSession, folder: str) -> DataFrame:
    """A table function, a scalar and a grouped aggregate of the user's own, all on batches: words' median length [UDF T2.11]."""
    words = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else t.split()), T.ArrayType(T.StringType()))

    @F.pandas_udf(T.DoubleType())
    def middle(sizes: pd.Series) -> float:
        return float(sizes.median())

    @F.pandas_udf(T.LongType())
    def number(sizes: pd.Series) -> int:
        return len(sizes)

    size = F.length("w").cast("double")
    return load(spark, folder, "part").select("p_brand", F.explode(words("p_name")).alias("w")).groupBy("p_brand").agg(middle(size).alias("median"), number(size).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        key_value_records, dataset_epochs, files_as_bytes, shuffled_corpora, landed_events, tables_by_format, exported_users, routed_stream, index_lookup, feed_sums, error_sample_sizes, event_blocks, rolled_files, appended_days,
        swapped_snapshot, bulk_upserts, resumed_deliveries, run_log, lazy_pieces, edited_profiles, unpacked_lists, mapped_events, path_rules, decoded_texts, udf_surface,
    )
}

_HALF = "SELECT o_orderstatus, o_orderpriority, o_totalprice / 2 AS half FROM orders, range(2) WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 50000 AND o_orderpriority NOT LIKE '4%' AND o_totalprice / 2 < 200000"

SQL: dict[str, str] = {
    "key_value_records": "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS text, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY ALL",
    "dataset_epochs": "SELECT CAST(i AS INTEGER) AS epoch, count(*) AS n, count(DISTINCT o_orderkey) AS orders, round(sum(o_totalprice), 2) AS price FROM orders, (VALUES (1), (2)) e(i) GROUP BY i",
    "files_as_bytes": "SELECT CAST(n_regionkey AS BIGINT) AS key, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM nation GROUP BY 1",
    "shuffled_corpora": "SELECT repo, lang, doc_id, CAST(row_number() OVER (PARTITION BY repo, lang ORDER BY md5('7:' || doc_id), doc_id) AS INTEGER) AS nth FROM documents WHERE repo IS NOT NULL AND lang IS NOT NULL",
    "landed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN 'broken' ELSE event_type END AS event, count(*) AS n, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS users, count(*) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS with_value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-21' GROUP BY ALL",
    "tables_by_format": "SELECT k AS kind, CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, min(n_name) AS first FROM nation, (VALUES ('parquet'), ('json'), ('csv')) f(k) GROUP BY ALL",
    "exported_users": f"WITH e AS (SELECT c_custkey AS id, c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]', '.', 'g') || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@' END || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '.IO' ELSE '.zz' END AS email FROM customer) SELECT *, regexp_full_match(email, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AND lower(regexp_extract(email, '[^.]*$')) IN ({', '.join(repr(x) for x in ENDINGS)}) AS valid FROM e",
    "routed_stream": "SELECT CASE WHEN event_type = 'purchase' THEN 'bought' ELSE 'other' END AS route, count(*) AS read, count(*) FILTER (value * 2 > 2) AS n, count(*) FILTER (value * 2 > 2) AS tapped, round(sum(value * 2) FILTER (value * 2 > 2), 2) AS total FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "index_lookup": "SELECT l_orderkey AS o_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS parts FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "feed_sums": f"WITH h AS ({_HALF}) SELECT 'sum' AS what, o_orderstatus AS name, count(*) AS n, round(sum(half), 2) AS total FROM h GROUP BY ALL UNION ALL SELECT 'sum', o_orderpriority, count(*), round(sum(half), 2) FROM h GROUP BY ALL UNION ALL SELECT 'error', 'filtered out', count(*), NULL FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0 UNION ALL SELECT 'error', 'not specified', count(*), NULL FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 50000 AND o_orderpriority LIKE '4%' HAVING count(*) > 0",
    "error_sample_sizes": "WITH e AS (SELECT CASE WHEN l_quantity > 45 THEN 'large ' || l_returnflag WHEN l_discount > 0.09 THEN 'cheap' END AS reason FROM lineitem) SELECT reason, count(*) AS n, least(count(*), 10) AS sampled FROM e WHERE reason IS NOT NULL GROUP BY 1",
    "event_blocks": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, event_id, event_type FROM events",
    "rolled_files": "SELECT count(*) FILTER (o_totalprice > 10000) AS written, count(*) FILTER (NOT o_totalprice > 10000) AS errors, count(*) AS rolled, true AS within FROM orders",
    "appended_days": "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "swapped_snapshot": "SELECT o_custkey, o_orderkey, o_orderstatus, CAST(2 AS INTEGER) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1",
    "bulk_upserts": "SELECT md5(user_id || '::' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS id, user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL",
    "resumed_deliveries": "SELECT count(*) AS rows, true AS within FROM customer WHERE c_custkey >= 51",
    "run_log": """SELECT CAST(1 AS INTEGER) AS nth, 'second' AS name, 'done' AS status, '{"tables": 1}' AS params, count(*) AS nations FROM nation UNION ALL SELECT 2, 'first', 'done', '{"tables": 2}', count(*) FROM nation""",
    "lazy_pieces": "WITH p AS (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE text <> '') SELECT doc_id, CAST(i AS INTEGER) AS piece, CAST(least(500, n - i * 500) AS INTEGER) AS chars FROM p",
    "edited_profiles": "SELECT DISTINCT change_seq, properties.user_id AS user_id, properties.country_code AS country_code, lower(properties.os) AS os, CAST(properties.windows_domain_membership AS INTEGER) AS windows_domain_membership, properties.cio_experiment_trial_end_v1 AS cio_experiment_trial_end_v1 FROM mixpanel_people_raw",
    "unpacked_lists": "WITH m AS (SELECT DISTINCT change_seq, distinct_id, properties.editors AS e FROM mixpanel_people_raw WHERE distinct_id IS NOT NULL AND len(properties.editors) > 0) SELECT concat_ws('-', distinct_id, change_seq, i) AS id, e[i] AS editor FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM m)",
    "mapped_events": f"SELECT CAST(ts AS DATE) AS day, CASE event_type {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in NAMES.items())} END AS name, count(*) AS n FROM events GROUP BY ALL HAVING name IS NOT NULL",
    "path_rules": r"""WITH d AS (SELECT path, lower(path) AS low, regexp_extract(path, '[^/]*$') AS name, coalesce(text, '') AS text FROM documents)
SELECT CASE WHEN path IS NULL THEN 'no path' WHEN NOT contains(name, '.') THEN 'no ending' WHEN length(name) - length(replace(name, '.', '')) > 1 THEN 'several dots' WHEN contains(low, '/node_modules/') THEN 'packages'
WHEN regexp_matches(low, '(^|/)(vendor|godeps|site-packages)/') OR regexp_matches(low, 'bindata\.go$') THEN 'vendored' WHEN NOT regexp_matches(low, '\.(py|go|js|java|ts|c|h|cpp|rb|md)$') THEN 'other ending'
WHEN strlen(text) > 50000 THEN 'too large' WHEN regexp_matches(lower(text), '(?m)^\s*(#|//|/\*|\*).*generated by') THEN 'generated' ELSE 'kept' END AS rule, count(*) AS files FROM d GROUP BY 1""",
    "decoded_texts": "SELECT w AS wanted, count(*) AS docs, count(*) AS whole, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents, (VALUES ('utf-8'), ('utf-16-be')) f(w) WHERE text <> '' AND NOT starts_with(text, chr(65279)) GROUP BY 1",
    "udf_surface": "SELECT p_brand, median(CAST(length(w) AS DOUBLE)) AS median, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1",
}
