"""Telemetry queries: rollups, activity, enrichment, snapshots, ranks. Operator ids of the survey in brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.aggregates import argmax_name, count_positive, ipv4_number, latest, mode_by_weight, nearest_rank, ratio_true, share, streak
from millrace.operators.enrich import prefix_join
from millrace.operators.ranks import at_positions
from millrace.operators.rollup import advance_rollup, daily_delta
from millrace.tables import load

END = "2024-01-31"
#: Address blocks with a made-up region, for the prefix join.
BLOCKS = [("198.18.0.0", 27, "west"), ("198.18.0.32", 27, "north"), ("198.18.0.0", 16, "world"), ("203.0.113.0", 25, "east"), ("203.0.113.0", 28, "harbour")]
#: Fixed weights of the example scorer.
WEIGHTS = {"_bias": -1.0, "big_spender": 0.8, "orders_n": 0.02, "urgent_share": 1.5}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumn("day", F.to_date("ts"))


def daily_user_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user, day and event type with sums, latest values, ratios and the day's percentiles [A4-A9 A14 J1 R6]."""
    e = _events(spark, folder)
    big = F.col("value") > 100
    rolled = e.groupBy("user_id", "day", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 8).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
        latest(F.col("value"), F.col("ts"), F.col("event_id")).alias("last_value"), F.count_if(big).alias("n_big"), F.round(ratio_true(big), 6).alias("share_big"), count_positive(F.col("value")).alias("n_positive"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    ranks = e.groupBy("user_id", "day").agg(nearest_rank(F.col("value"), 0.5).alias("p50"), nearest_rank(F.col("value"), 0.9).alias("p90"))
    return rolled.join(ranks, ["user_id", "day"])


def user_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of a user's events: any and all of a kind, any non-null value [A10 A11]."""
    e = _events(spark, folder)
    err = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(F.bool_or(err).alias("had_error"), F.bool_and(F.col("value") > 0).alias("always_positive"), F.min("event_type").alias("any_type"), F.count_distinct("day").alias("days"), F.count_distinct(F.when(err, F.col("day"))).alias("error_days"))


def latest_value_per_user(spark: SparkSession, folder: str) -> DataFrame:
    """A user's newest event, whole [A9 A45 U3]."""
    row = latest(F.struct("event_id", "event_type", "value"), F.col("ts"), F.col("event_id"))
    return load(spark, folder, "events").groupBy("user_id").agg(row.alias("r")).select("user_id", "r.*")


def activation_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """First activity per user; of known ones only those that turn out earlier, and new users [A22 J3]."""
    e = _events(spark, folder)
    known = e.filter("day >= '2024-01-10'").groupBy("user_id").agg(F.min("ts").alias("known_ts"))
    seen = e.groupBy("user_id").agg(F.min("ts").alias("activated"))
    return known.join(seen, "user_id", "right").filter("known_ts IS NULL OR activated < known_ts").select("user_id", "activated")


def daily_active(spark: SparkSession, folder: str) -> DataFrame:
    """Users per day and event type, and rows behind them [A12 A46]."""
    return _events(spark, folder).groupBy("day", "event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


def daily_active_users_append(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users of each day, as they are appended to the table of active users [A46]."""
    return _events(spark, folder).filter("value > 1").select("user_id", "day").distinct()


def weekly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user and number of whole weeks before the end [A23]."""
    week = F.expr(f"cast(timestampdiff(DAY, ts, timestamp_ntz'{END} 00:00:00') div 7 as int)")
    return load(spark, folder, "events").groupBy("user_id", week.alias("weeks_ago"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def activity_streak(spark: SparkSession, folder: str) -> DataFrame:
    """How many weeks in a row, back from the end, a user was active [A18 W6]."""
    week = F.expr(f"cast(timestampdiff(DAY, ts, timestamp_ntz'{END} 00:00:00') div 7 as int)")
    return load(spark, folder, "events").groupBy("user_id").agg(streak(week).alias("weeks"))


def value_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Users' totals at the 99 percentiles, nearest rank [A13 A14]."""
    per_user = load(spark, folder, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return at_positions(per_user, "total", [i / 100 for i in range(1, 100)]).withColumnRenamed("nth", "pct")


def user_percentile_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The largest of 99 percentiles that a user's total reaches [A15]."""
    per_user = load(spark, folder, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    ladder = value_percentiles(spark, folder).agg(F.array_sort(F.collect_list(F.struct("total", "pct"))).alias("steps"))  # 99 steps
    joined = per_user.withColumn("steps", ladder.scalar())
    return joined.select("user_id", "total", F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["total"] <= F.col("total")), lambda s: s["pct"])), F.lit(0)).alias("pct"))


def trailing_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over the last 7 and 28 days, per user and active day [W4]."""
    daily = _events(spark, folder).groupBy("user_id", "day").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.unix_date("day"))
    return daily.select("user_id", "day", F.round(F.sum("v").over(w.rangeBetween(-6, 0)), 4).alias("sum_7d"), F.round(F.sum("v").over(w.rangeBetween(-27, 0)), 4).alias("sum_28d"))


def incremental_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The 7-day rollup of the last day, from the day before's, the day's delta and the expired day's [A19 A20 J7]."""
    deltas = daily_delta(_events(spark, folder), "user_id", "day", {"events_n": F.count(F.lit(1)), "value_sum": F.sum("value")}, {"last_type": latest(F.col("event_type"), F.col("ts"), F.col("event_id"))})
    before = deltas.filter("day BETWEEN '2024-01-23' AND '2024-01-29'").groupBy("user_id").agg(F.sum("events_n").alias("events_n"), F.sum("value_sum").alias("value_sum"), F.max_by("last_type", "day").alias("last_type"))
    out = advance_rollup(before, deltas.filter("day = '2024-01-30'"), deltas.filter("day = '2024-01-23'"), "user_id", ["events_n", "value_sum"], ["last_type"])
    return out.select("user_id", "events_n", F.round("value_sum", 3).alias("value_sum"), "last_type")


def main_event_by_value(spark: SparkSession, folder: str) -> DataFrame:
    """The event type with most value of each user [A21]."""
    e = load(spark, folder, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return mode_by_weight(e, ["user_id"], "event_type", "cents")


def rolling_mean_14d(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and maximum of 14 days' totals, null until 14 days are there [W2]."""
    daily = _events(spark, folder).groupBy("day").agg(F.sum("value").alias("v"))
    w = Window.orderBy("day").rowsBetween(-13, 0)  # one row per day
    full = F.count(F.lit(1)).over(w) == 14
    return daily.select("day", F.round(F.when(full, F.avg("v").over(w)), 8).alias("mean_14d"), F.round(F.when(full, F.max("v").over(w)), 4).alias("max_14d"))


def weekday_engaged(spark: SparkSession, folder: str) -> DataFrame:
    """On weekdays, mean and median over users with at least 2 events of their value per event; the last day is left out [A41]."""
    e = _events(spark, folder).filter("weekday(day) < 5 AND day < '2024-01-30'")
    users = e.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")).filter("n >= 2")
    return users.groupBy("day").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("v"), 8).alias("mean"), F.round(F.median("v"), 8).alias("median"))


def failure_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each event type per day, with distinct users [A38 A39 W5]."""
    counts = _events(spark, folder).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return counts.select("day", "event_type", "n", "users", F.round(share("n", "day"), 6).alias("part"))


def users_without_success(spark: SparkSession, folder: str) -> DataFrame:
    """User days with errors but no purchase [A40]."""
    return _events(spark, folder).groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("bought")).filter("errors > 0 AND bought = 0").select("user_id", "day", "errors")


def spread_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Variance of users' means by event type, for types with at least 10 users [A37 A3]."""
    users = load(spark, folder, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return users.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.round(F.var_samp("m"), 4).alias("variance"), F.round(F.stddev_pop("m"), 4).alias("deviation")).filter("users >= 10")


def props_sums(spark: SparkSession, folder: str) -> DataFrame:
    """A field of the JSON properties, extracted and summed [P16]."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return load(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_n"), F.max(k).alias("k_max"))


def source_map_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Completions by source: a map column unnested and summed, with each source's share [J6 A42]."""
    rows = load(spark, folder, "kite_status_normalized").select(F.explode("properties__completions_shown_by_source").alias("source", "n"))
    sums = rows.groupBy("source").agg(F.sum("n").alias("shown"), F.count(F.lit(1)).alias("reports"))
    return sums.select("source", "shown", "reports", F.round(share("shown"), 6).alias("part"))


def user_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events in batches of 25 in order of time, the last one partial [P12 W3]."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = load(spark, folder, "events").withColumn("batch", ((F.row_number().over(w) - 1) / 25).cast("int"))
    return numbered.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def user_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """A user's timeline with whole seconds since the event before [W3]."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    return load(spark, folder, "events").select("event_id", "user_id", F.row_number().over(w).alias("nth"), F.timestamp_diff("SECOND", before, F.col("ts")).alias("gap_s"))


def index_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Events per 10-day tumbling window counted from 1970 [X3 R6]."""
    start = F.date_from_unix_date((F.floor(F.unix_date("day") / 10) * 10).cast("int"))
    return _events(spark, folder).groupBy(start.alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def ip_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The region of each message's address by the longest matching block [J5 P30]."""
    m = load(spark, folder, "kite_status_normalized").select("messageid", "sourceip").distinct()
    blocks = spark.createDataFrame(BLOCKS, "base string, bits int, region string")
    return prefix_join(m.withColumn("ip", ipv4_number(F.col("sourceip"))), "ip", blocks.withColumn("base", ipv4_number(F.col("base"))), "base", "bits", ["region"]).select("messageid", "ip", "region")


def country_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with nation and region, kept if unknown [J2]."""
    c, n, r = (load(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").groupBy("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def customers_without_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers never seen in orders [J4 U2]."""
    o = load(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, folder, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def ordered_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer with a flag for orders above a price [J4 J9 J10]."""
    o = load(spark, folder, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("seen")).distinct()
    return load(spark, folder, "customer").join(o, "c_custkey", "left").select("c_custkey", F.col("seen").isNotNull().alias("big_order"))


def latest_order_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot and delta united, the newest order of each customer kept [U1 U3 A45 K9]."""
    o = load(spark, folder, "orders")
    snapshot, delta = o.filter("o_orderdate < '1998-01-01'"), o.filter("o_orderdate >= '1998-01-01'")
    row = latest(F.struct("o_orderkey", "o_orderstatus", "o_orderdate"), F.col("o_orderdate"), F.col("o_orderkey"))
    return snapshot.unionByName(delta).groupBy("o_custkey").agg(row.alias("r")).select("o_custkey", "r.*")


def primary_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the return flag with most quantity, ties to the first of A, N, R [P23]."""
    sums = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in "ANR"])
    return sums.select("l_orderkey", argmax_name(["A", "N", "R"]).alias("flag"))


def conversion_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Features per customer, missing ones imputed, and a logistic score with fixed weights [M5 M6 M15 J2]."""
    o = load(spark, folder, "orders")
    f = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_n"), F.bool_or(F.col("o_totalprice") > 450000).alias("big_spender"), F.avg(F.col("o_orderpriority").startswith("1").cast("double")).alias("urgent_share"))
    c = load(spark, folder, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left")
    full = c.select("c_custkey", F.coalesce("orders_n", F.lit(0)).cast("bigint").alias("orders_n"), F.coalesce("big_spender", F.lit(False)).alias("big_spender"), F.coalesce("urgent_share", F.lit(0.2)).alias("urgent_share"))
    z = sum((F.col(k).cast("double") * w for k, w in WEIGHTS.items() if k != "_bias"), F.lit(WEIGHTS["_bias"]))
    return full.select("c_custkey", "orders_n", "big_spender", F.round("urgent_share", 6).alias("urgent_share"), F.round(1 / (1 + F.exp(-z)), 6).alias("score"))


def top_parts_per_brand(spark: SparkSession, folder: str) -> DataFrame:
    """The three parts of each brand with most quantity [O2 O6]."""
    q = load(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    w = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "l_partkey")
    return q.join(p, "l_partkey").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("p_brand", "place", F.col("l_partkey").alias("p_partkey"), "qty")


def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred customers with most orders, a top-k report [O1 O3 O5]."""
    return load(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(100)


def top_share_of_types(spark: SparkSession, folder: str) -> DataFrame:
    """Part types, largest first, until they make up 80 % of quantity [O4]."""
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    sums = load(spark, folder, "lineitem").join(p, "l_partkey").groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("qty"))
    w = Window.orderBy(F.desc("qty"), "p_type", "p_brand")  # one row per type and brand
    run = sums.withColumn("before", F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("qty")).withColumn("whole", F.sum("qty").over(Window.partitionBy()))
    return run.filter("before < 0.8 * whole").select("p_type", "p_brand", "qty")


def longest_step(spark: SparkSession, folder: str) -> DataFrame:
    """Of each order the line that took longest to ship [A47]."""
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.date_diff("l_shipdate", "o_orderdate")
    return load(spark, folder, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(days, -F.col("l_linenumber"))).alias("line"), F.max(days).alias("days"))


def calendar_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly totals per customer, with the weeks behind them, beside the year's [A43 J11]."""
    o = load(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.weekofyear("o_orderdate").alias("week"), F.month("o_orderdate").alias("month"), "o_totalprice")
    year = o.groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("year_total"))
    return o.groupBy("o_custkey", "year", "month").agg(F.round(F.sum("o_totalprice"), 2).alias("month_total"), F.count_distinct("week").alias("weeks")).join(year, ["o_custkey", "year"])


def price_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in 20 bins of equal width [A44]."""
    b = F.least(F.floor(F.col("o_totalprice") / 25000), F.lit(19)).cast("int")
    return load(spark, folder, "orders").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


def clean_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of heartbeats that are plain ASCII without control characters, and those that aren't [P24 P25 P5 P7]."""
    k = load(spark, folder, "kite_status").filter("userid IS NOT NULL")
    kind = F.when(F.col("userid").rlike(r"[\x00-\x1F\x7F]"), "control").when(~F.col("userid").rlike(r"^[\x20-\x7E]*$"), "other").when(F.length("userid") < 4, "short").otherwise("plain")
    return k.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("userid").alias("ids"))


def active_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with editing activity, per OS and client date [P1 P5 P6 P21 T28]."""
    k = load(spark, folder, "kite_status_normalized").filter("coalesce(properties__python_events, 0) + coalesce(properties__python_edit, 0) > 0")
    date = F.to_date(F.regexp_extract("properties__client_version", r"^1\.(\d{8})\.", 1).substr(1, 8), "yyyyMMdd")
    good = k.filter(F.col("properties__client_version").rlike(r"^1\.\d{8}\."))
    return good.groupBy(F.lower(F.trim("properties__os")).alias("os"), date.alias("client_date")).agg(F.count(F.lit(1)).alias("n"))


def cpu_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The largest of the samples listed in each message's text, per file [P20]."""
    samples = F.split(F.get_json_object("properties", "$.cpu_samples"), ",")
    peak = F.array_max(F.transform(samples, lambda x: x.try_cast("double")))
    return load(spark, folder, "kite_status").select("prefix", peak.alias("peak")).groupBy("prefix").agg(F.count("peak").alias("n"), F.max("peak").alias("most"), F.round(F.avg("peak"), 8).alias("mean"))


def error_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Rows routed aside by reason, and the good ones counted [P7]."""
    k = load(spark, folder, "kite_status")
    reason = F.when(F.col("userid").isNull() | (F.col("userid") == ""), "no user").when(F.col("event").isNull() | (F.col("event") == ""), "no event").when(~F.coalesce("properties", F.lit("")).startswith("{"), "no object").otherwise("good")
    return k.groupBy("prefix", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        daily_user_rollup, user_flags, latest_value_per_user, activation_upsert, daily_active, daily_active_users_append, weekly_counts, activity_streak, value_percentiles, user_percentile_rank, trailing_sums,
        incremental_rollup, main_event_by_value, rolling_mean_14d, weekday_engaged, failure_share, users_without_success, spread_by_type, props_sums, source_map_sums, user_batches, user_gaps, index_epochs,
        ip_regions, country_enrich, customers_without_orders, ordered_flag, latest_order_snapshot, primary_mode, conversion_scores, top_parts_per_brand, top_customers, top_share_of_types, longest_step,
        calendar_totals, price_histogram, clean_ids, active_messages, cpu_peaks, error_reasons,
    )
}

_DAY = "CAST(ts AS DATE)"
_WEEK = f"CAST(date_sub('day', ts, TIMESTAMP '{END}') // 7 AS INTEGER)"
_IP = "({0}[1]::BIGINT * 16777216 + {0}[2]::BIGINT * 65536 + {0}[3]::BIGINT * 256 + {0}[4]::BIGINT)"
_PCT = """u AS (SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1), s AS (SELECT list_sort(list(total)) AS l FROM u),
pc AS (SELECT CAST(p AS INTEGER) AS pct, l[least(p * len(l) // 100, len(l) - 1) + 1] AS total FROM s, range(1, 100) r(p))"""

SQL: dict[str, str] = {
    "daily_user_rollup": f"""WITH e AS (SELECT *, {_DAY} AS day FROM events),
a AS (SELECT user_id, day, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) AS last_value, CAST(count_if(value > 100) AS BIGINT) AS n_big, round(count_if(value > 100) / nullif(count(value), 0), 6) AS share_big, CASE WHEN count(value) > 0 THEN CAST(count_if(value > 0) AS BIGINT) END AS n_positive, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY ALL),
b AS (SELECT user_id, day, list_sort(list(value)) AS l FROM e GROUP BY ALL)
SELECT a.*, l[least(floor(len(l) * 0.5)::INT, len(l) - 1) + 1] AS p50, l[least(floor(len(l) * 0.9)::INT, len(l) - 1) + 1] AS p90 FROM a JOIN b USING (user_id, day)""",
    "user_flags": f"SELECT user_id, bool_or(event_type = 'error') AS had_error, bool_and(value > 0) AS always_positive, min(event_type) AS any_type, count(DISTINCT {_DAY}) AS days, count(DISTINCT CASE WHEN event_type = 'error' THEN {_DAY} END) AS error_days FROM events GROUP BY 1",
    "latest_value_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "activation_upsert": "WITH k AS (SELECT user_id, min(ts) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1), s AS (SELECT user_id, min(ts) AS activated FROM events GROUP BY 1) SELECT user_id, activated FROM s LEFT JOIN k USING (user_id) WHERE t IS NULL OR activated < t",
    "daily_active": f"SELECT {_DAY} AS day, event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY ALL",
    "daily_active_users_append": f"SELECT DISTINCT user_id, {_DAY} AS day FROM events WHERE value > 1",
    "weekly_counts": f"SELECT user_id, {_WEEK} AS weeks_ago, event_type, count(*) AS n FROM events GROUP BY ALL",
    "activity_streak": f"WITH w AS (SELECT DISTINCT user_id, {_WEEK} AS w FROM events), r AS (SELECT user_id, w, row_number() OVER (PARTITION BY user_id ORDER BY w) - 1 AS i FROM w) SELECT user_id, CAST(count_if(w = i) AS INTEGER) AS weeks FROM r GROUP BY 1",
    "value_percentiles": f"WITH {_PCT} SELECT pct, total FROM pc",
    "user_percentile_rank": f"WITH {_PCT} SELECT user_id, u.total, CAST(coalesce((SELECT max(pct) FROM pc WHERE pc.total <= u.total), 0) AS INTEGER) AS pct FROM u",
    "trailing_sums": f"WITH d AS (SELECT user_id, {_DAY} AS day, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS sum_7d, round(sum(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW), 4) AS sum_28d FROM d",
    "incremental_rollup": f"SELECT user_id, CAST(coalesce(count(*) FILTER ({_DAY} >= DATE '2024-01-24'), 0) AS BIGINT) AS events_n, round(coalesce(sum(value) FILTER ({_DAY} >= DATE '2024-01-24'), 0), 3) AS value_sum, arg_max(event_type, (ts, event_id)) AS last_type FROM events WHERE {_DAY} BETWEEN DATE '2024-01-23' AND DATE '2024-01-30' GROUP BY 1",
    "main_event_by_value": "WITH s AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_type) = 1",
    "rolling_mean_14d": f"WITH d AS (SELECT {_DAY} AS day, sum(value) AS v FROM events GROUP BY 1) SELECT day, round(CASE WHEN count(*) OVER w = 14 THEN avg(v) OVER w END, 8) AS mean_14d, round(CASE WHEN count(*) OVER w = 14 THEN max(v) OVER w END, 4) AS max_14d FROM d WINDOW w AS (ORDER BY day ROWS 13 PRECEDING)",
    "weekday_engaged": f"WITH u AS (SELECT {_DAY} AS day, user_id, count(*) AS n, avg(value) AS v FROM events WHERE isodow(ts) < 6 AND {_DAY} < DATE '2024-01-30' GROUP BY ALL HAVING count(*) >= 2) SELECT day, count(*) AS users, round(avg(v), 8) AS mean, round(median(v), 8) AS median FROM u GROUP BY 1",
    "failure_share": f"WITH c AS (SELECT {_DAY} AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY day), 6) AS part FROM c",
    "users_without_success": f"SELECT user_id, {_DAY} AS day, CAST(count_if(event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY ALL HAVING count_if(event_type = 'error') > 0 AND count_if(event_type = 'purchase') = 0",
    "spread_by_type": "WITH u AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, count(*) AS users, round(var_samp(m), 4) AS variance, round(stddev_pop(m), 4) AS deviation FROM u GROUP BY 1 HAVING count(*) >= 10",
    "props_sums": "WITH e AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, CAST(sum(k) AS BIGINT) AS k_sum, count(k) AS k_n, max(k) AS k_max FROM e GROUP BY 1",
    "source_map_sums": "WITH m AS (SELECT unnest(map_entries(properties__completions_shown_by_source)) AS e FROM kite_status_normalized), s AS (SELECT e.key AS source, CAST(sum(e.value) AS BIGINT) AS shown, count(*) AS reports FROM m GROUP BY 1) SELECT *, round(shown / sum(shown) OVER (), 6) AS part FROM s",
    "user_batches": "WITH r AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 25 AS INTEGER) AS batch FROM events) SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL",
    "user_gaps": "SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS nth, date_sub('second', lag(ts) OVER w, ts) AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "index_epochs": f"SELECT DATE '1970-01-01' + CAST(floor(({_DAY} - DATE '1970-01-01') / 10) * 10 AS INTEGER) AS epoch, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "ip_regions": f"""WITH m AS (SELECT DISTINCT messageid, sourceip FROM kite_status_normalized), i AS (SELECT messageid, string_split(sourceip, '.') AS p FROM m), n AS (SELECT messageid, CASE WHEN len(p) = 4 THEN {_IP.format('p')} END AS ip FROM i),
b AS (SELECT {_IP.format("string_split(base, '.')")} AS base, bits, region FROM (VALUES {', '.join(f"('{a}', {b}, '{r}')" for a, b, r in BLOCKS)}) v(base, bits, region))
SELECT messageid, ip, region FROM n LEFT JOIN b ON ip // (2 ** (32 - bits))::BIGINT = base // (2 ** (32 - bits))::BIGINT QUALIFY row_number() OVER (PARTITION BY messageid, ip ORDER BY bits DESC) = 1""",
    "country_enrich": "SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "ordered_flag": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL) AS big_order FROM customer",
    "latest_order_snapshot": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "primary_mode": "WITH s AS (SELECT l_orderkey, l_returnflag AS flag, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL) SELECT l_orderkey, flag FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, flag) = 1",
    "conversion_scores": f"""WITH f AS (SELECT o_custkey, count(*) AS orders_n, bool_or(o_totalprice > 450000) AS big_spender, avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END) AS urgent_share FROM orders GROUP BY 1),
c AS (SELECT c_custkey, CAST(coalesce(orders_n, 0) AS BIGINT) AS orders_n, coalesce(big_spender, false) AS big_spender, coalesce(urgent_share, 0.2) AS urgent_share FROM customer LEFT JOIN f ON c_custkey = o_custkey)
SELECT c_custkey, orders_n, big_spender, round(urgent_share, 6) AS urgent_share, round(1 / (1 + exp(-({WEIGHTS['_bias']} + {WEIGHTS['big_spender']} * big_spender::INT + {WEIGHTS['orders_n']} * orders_n + {WEIGHTS['urgent_share']} * urgent_share))), 6) AS score FROM c""",
    "top_parts_per_brand": "WITH q AS (SELECT p_brand, p_partkey, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS INTEGER) AS place, p_partkey, qty FROM q) SELECT * FROM r WHERE place <= 3",
    "top_customers": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 100",
    "top_share_of_types": "WITH s AS (SELECT p_type, p_brand, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, sum(qty) OVER (ORDER BY qty DESC, p_type, p_brand ROWS UNBOUNDED PRECEDING) - qty AS before, sum(qty) OVER () AS whole FROM s) SELECT p_type, p_brand, qty FROM r WHERE before < 0.8 * whole",
    "longest_step": "WITH d AS (SELECT l_orderkey, l_linenumber AS line, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT l_orderkey, line, days FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY days DESC, line) = 1",
    "calendar_totals": "WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, week(o_orderdate) AS week, o_totalprice FROM orders), y AS (SELECT o_custkey, year, round(sum(o_totalprice), 2) AS year_total FROM o GROUP BY ALL) SELECT o_custkey, year, month, round(sum(o_totalprice), 2) AS month_total, count(DISTINCT week) AS weeks, year_total FROM o JOIN y USING (o_custkey, year) GROUP BY o_custkey, year, month, year_total",
    "price_histogram": "SELECT CAST(least(floor(o_totalprice / 25000), 19) AS INTEGER) AS bin, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1",
    "clean_ids": r"SELECT CASE WHEN regexp_matches(userid, '[\x00-\x1F\x7F]') THEN 'control' WHEN NOT regexp_full_match(userid, '[\x20-\x7E]*') THEN 'other' WHEN length(userid) < 4 THEN 'short' ELSE 'plain' END AS kind, count(*) AS n, count(DISTINCT userid) AS ids FROM kite_status WHERE userid IS NOT NULL GROUP BY 1",
    "active_messages": r"SELECT lower(trim(properties__os)) AS os, CAST(strptime(regexp_extract(properties__client_version, '^1\.(\d{8})\.', 1), '%Y%m%d') AS DATE) AS client_date, count(*) AS n FROM kite_status_normalized WHERE coalesce(properties__python_events, 0) + coalesce(properties__python_edit, 0) > 0 AND regexp_matches(properties__client_version, '^1\.\d{8}\.') GROUP BY ALL",
    "cpu_peaks": "WITH s AS (SELECT prefix, list_max(list_transform(string_split(CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.cpu_samples') END, ','), lambda x: try_cast(x AS DOUBLE))) AS peak FROM kite_status) SELECT prefix, count(peak) AS n, max(peak) AS most, round(avg(peak), 8) AS mean FROM s GROUP BY 1",
    "error_reasons": "SELECT prefix, CASE WHEN coalesce(userid, '') = '' THEN 'no user' WHEN coalesce(event, '') = '' THEN 'no event' WHEN NOT starts_with(coalesce(properties, ''), '{') THEN 'no object' ELSE 'good' END AS reason, count(*) AS n FROM kite_status GROUP BY ALL",
}
