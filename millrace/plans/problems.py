"""Queries of the general data-processing problems, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.clean import clean_user, epoch_ms, instant_ms, plain, strip
from millrace.operators.changes import replay_changes
from millrace.operators.drift import catalogue, consistent_table, file_fields, schema_changes
from millrace.operators.nested import nested_nodes
from millrace.operators.sessions import sessions
from millrace.session import scratch_dir
from millrace.streaming.features import ANY, long_form, read_table_stream, stream_features
from millrace.streaming.sessions import run_sessions
from millrace.tables import load

HOUR_MS = 3_600_000
FEATURES = {"event": "event", "properties__os": "os", "properties__cpu_threads": "cpu_threads", "properties__git_found": "git_found"}
TOTALS = ["properties__python_events", "properties__completions_shown", "properties__completions_num_selected"]
PROFILE = ["user_id", "plan", "country_code", "os", "windows_domain_membership", "cio_experiment_trial_end_v1", "editors"]


def _beats(raw: DataFrame) -> DataFrame:
    return raw.select(clean_user("userid").alias("userid"), instant_ms("timestamp").alias("ms"), F.nullif("messageid", F.lit("")).alias("messageid"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every session of every user: cleaned user, first and last time."""
    stream = _beats(read_table_stream(spark, folder, "kite_status"))
    return run_sessions(stream, scratch_dir(spark), "userid", "ms").select("userid", "start_ms", "end_ms")


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with duration, rows and distinct messages."""
    return sessions(_beats(load(spark, folder, "kite_status")), "userid", "ms", message="messageid")


def _messages(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_user("userid").alias("userid"), instant_ms("timestamp").alias("ms"), F.nullif("messageid", F.lit("")).alias("messageid"), plain("event").alias("event"), plain("properties__os").alias("os"),
        F.col("properties__cpu_threads").cast("string").alias("cpu_threads"), F.col("properties__git_found").cast("string").alias("git_found"), *TOTALS,
    )


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return stream_features(spark, folder, "kite_status_normalized", _messages, "userid", "ms", "messageid", FEATURES, TOTALS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values a user gave up: in at least 4 messages, the last more than 48 hours before the user's last message."""
    rows = _rows(spark, folder).withColumnRenamed("last_ms", "_own")

    def given_up(f: str) -> Column:
        stale = F.map_filter(f, lambda _, c: (c["n"] >= 4) & (c["last_ms"] < F.col("_own") - 48 * HOUR_MS))
        return F.transform(F.coalesce(F.map_keys(stale), F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("field"), v.alias("val")))

    each = [given_up(f) for f in FEATURES]
    return rows.select(F.col("entity").alias("userid"), F.explode(F.concat(*each)).alias("_e")).select("userid", "_e.field", "_e.val")


def p3_features(spark: SparkSession, folder: str) -> DataFrame:
    """One feature row per user, in long form: count, last time and totals of each kind of value."""
    return long_form(_rows(spark, folder), list(FEATURES), TOTALS).withColumnRenamed("entity", "userid")


def p3_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per user with a map per field, as JSON texts."""
    rows = _rows(spark, folder)
    return rows.select(F.col("entity").alias("userid"), *[F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes if c != "entity"])


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    raw = load(spark, folder, "mixpanel_people_raw")
    op = F.substring(F.lower(strip("op")), 1, 1)
    return raw.select(F.nullif(strip("distinct_id"), F.lit("")).alias("distinct_id"), epoch_ms("time").alias("time_ms"), "change_seq", op.alias("op"), "last_seen", *[F.col(f"properties.{p}").alias(p) for p in PROFILE])


def p4_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The current profile of every person who exists after all changes."""
    return replay_changes(_changes(spark, folder), "distinct_id", "time_ms", "change_seq", "op", ["last_seen", *PROFILE], partial=False)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every existing profile with the sequence number of its last change."""
    return p4_profiles(spark, folder).select("distinct_id", "change_seq")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object that is an element of an array, with the nearest enclosing one."""
    nodes = nested_nodes(load(spark, folder, "kite_status"), "messageid", "properties", values=False, elements_only=True)
    return nodes.select(F.col("message").alias("messageid"), "node", "parent")


def p5_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of all kinds with interval labels and own fields."""
    return nested_nodes(load(spark, folder, "kite_status"), "messageid", "properties").withColumnRenamed("message", "messageid")


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "kite_status").select("prefix", "messageid", clean_user("userid").alias("userid"), instant_ms("timestamp").alias("ms"), "properties")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of each landing file's fields against the file before."""
    return schema_changes(_landed(spark, folder), "prefix", "properties", "userid", "ms").withColumnRenamed("file", "prefix")


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """One consistent table of all fields of all files."""
    rows = _landed(spark, folder)
    fields = file_fields(rows, "prefix", "properties")
    column, kinds = catalogue(fields, schema_changes(rows, "prefix", "properties", "userid", "ms", fields))
    whole = consistent_table(rows, "prefix", "properties", ["messageid", "userid", "ms"], column, kinds)
    return whole.withColumn("ms", F.col("ms").cast("bigint")).withColumn("other", F.to_json("other"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_sessions, p3_found, p3_features, p3_feature_rows, p4_found, p4_profiles, p5_found, p5_nodes, p7_found, p7_table)}

# DuckDB: an id without control characters, the instant of a time text in milliseconds, and the plain form of a label
_USER = r"nullif(regexp_replace(userid, '[\x00-\x1F\x7F]', '', 'g'), '')"
_MS = r"CASE WHEN regexp_full_match(timestamp, '\d+') THEN try_cast(timestamp AS BIGINT) ELSE epoch_ms(try_cast(CASE WHEN regexp_matches(timestamp, '(Z|[+-]\d\d:\d\d)$') THEN timestamp ELSE timestamp || 'Z' END AS TIMESTAMPTZ)) END"
_PLAIN = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_HEARTBEATS = f"SELECT * FROM (SELECT {_USER} AS userid, {_MS} AS ms, nullif(messageid, '') AS messageid FROM kite_status) WHERE userid IS NOT NULL AND ms IS NOT NULL"
_SESSIONS = f"""WITH e AS ({_HEARTBEATS}), o AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY userid ORDER BY ms) <= 1800000 THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY userid ORDER BY ms ROWS UNBOUNDED PRECEDING) AS part FROM o)"""
_MESSAGES = f"""SELECT * FROM (SELECT {_USER} AS userid, {_MS} AS ms, messageid, {_PLAIN.format('event')} AS event, {_PLAIN.format('properties__os')} AS os, CAST(properties__cpu_threads AS VARCHAR) AS cpu_threads, CAST(properties__git_found AS VARCHAR) AS git_found, {', '.join(TOTALS)},
row_number() OVER (PARTITION BY messageid ORDER BY userid) AS copy FROM kite_status_normalized WHERE {_USER} IS NOT NULL AND ({_MS}) IS NOT NULL) WHERE copy = 1"""
_COUNTERS = f"WITH m AS ({_MESSAGES}), v AS (SELECT *, '{ANY}' AS field, '' AS val FROM m" + "".join(f" UNION ALL SELECT *, '{f}', {c} FROM m WHERE {c} <> ''" for f, c in FEATURES.items()) + f"), c AS (SELECT userid, field, val, count(*) AS n, max(ms) AS last_ms, {', '.join(f'CAST(sum(coalesce({t}, 0)) AS BIGINT) AS {t}' for t in TOTALS)} FROM v GROUP BY ALL)"
_CHANGES = """WITH c AS (SELECT *, trim(distinct_id) AS id, CASE WHEN abs(time) >= 100000000000 THEN time ELSE time * 1000 END AS time_ms, lower(trim(op))[1] AS kind FROM mixpanel_people_raw),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_ms DESC, change_seq DESC, last_seen NULLS LAST) AS nth FROM c WHERE id <> '' AND time_ms IS NOT NULL)"""

SQL: dict[str, str] = {
    "p2_found": f"{_SESSIONS} SELECT userid, min(ms) AS start_ms, max(ms) AS end_ms FROM s GROUP BY userid, part",
    "p2_sessions": f"{_SESSIONS} SELECT userid, min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS events, count(DISTINCT messageid) AS messages FROM s GROUP BY userid, part",
    "p3_found": f"{_COUNTERS} SELECT c.userid, c.field, c.val FROM c JOIN c a ON a.userid = c.userid AND a.field = '{ANY}' WHERE c.field <> '{ANY}' AND c.n >= 4 AND c.last_ms < a.last_ms - {48 * HOUR_MS}",
    "p3_features": f"{_COUNTERS} SELECT * FROM c",
    "p4_found": f"{_CHANGES} SELECT id AS distinct_id, change_seq FROM l WHERE nth = 1 AND kind <> 'd'",
    "p4_profiles": f"{_CHANGES} SELECT id AS distinct_id, time_ms, change_seq, last_seen, {', '.join(f'properties.{p} AS {p}' for p in PROFILE)} FROM l WHERE nth = 1 AND kind <> 'd'",
}
