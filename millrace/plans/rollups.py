"""Rollups from a schema, map results, patterns of code, models' figures. Operator ids of the survey in brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.clean import clean_user, instant_ms, plain
from millrace.operators.rollup import WindowSums, map_text, schema_rollup
from millrace.session import cut
from millrace.tables import load

DAYS = (7, 28, 84)
END = "2024-01-30"
#: Fixed values of the example price model: bias, weight of the price, and the prices offered.
PRICE_MODEL, PRICES = (2.0, -0.4), (2.0, 4.0, 6.0, 8.0, 10.0)
#: In a type's estimate an attribute it never shows costs this much.
OUTLIER = -6.0
LISTED_BYTES = 8_000_000

#: The typed columns of the flattened telemetry of which the daily rollup is made.
ROLLED = {
    "properties__client_version": "string", "properties__os": "string", "properties__cpu_threads": "bigint", "properties__git_found": "boolean", "properties__python_edit": "int", "properties__python_events": "int",
    "properties__completions_shown": "int", "properties__completions_num_selected": "int", "properties__completions_shown_by_source": "map<string,int>", "maxmind__country_name": "string", "maxmind__country_iso_code": "string",
    "maxmind__subdivision_1_name": "string", "maxmind__city_name": "string", "maxmind__time_zone": "string", "monetizable_score": "double", "monetizable_model_version": "string",
}


def daily_schema_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user, day and event with aggregates generated from the columns' types, some four for each [A4-A11 A16 A17 F-map]."""
    raw = load(spark, folder, "kite_status_normalized")
    day = F.date_from_unix_date(F.floor(F.col("_ms") / 86_400_000).cast("int"))
    rows = raw.select(clean_user("userid").alias("userid"), instant_ms("timestamp").alias("_ms"), plain("event").alias("event"), "messageid", *ROLLED).filter("userid IS NOT NULL AND _ms IS NOT NULL").withColumn("day", day)
    return schema_rollup(rows, ["userid", "day", "event"], ["_ms", "messageid"], ROLLED)


def rollup_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The 7-, 28- and 84-day rollup of the last day: the day before's, the day's delta, less the deltas that expire [A16 A17 A19 A20 A21 J7 W4 F-map]."""
    e = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    deltas = cut(e.groupBy("user_id", "day", "event_type").agg(F.count(F.lit(1)).alias("n")))
    window = WindowSums(deltas, "user_id", "day", "event_type", "n", DAYS)
    now = window.advance(window.at(F.date_sub(F.lit(END).cast("date"), 1)), F.lit(END).cast("date"))
    return now.select("user_id", *[F.nullif(f"total_{d}d", F.lit(0)).alias(f"n_{d}d") for d in DAYS], *[map_text(F.col(f"map_{d}d")).alias(f"by_type_{d}d") for d in DAYS], "most_28d")


def fanned_out_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Customers joined with many orders of many lines: each side is summed before it fans out [J8]."""
    lines = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    orders = load(spark, folder, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"), F.sum("qty").alias("qty"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return load(spark, folder, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").withColumns({"orders": F.coalesce("orders", F.lit(0))})


def lines_of_known_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the parts of a known set, which is sent to all tasks where its size allows [J9 J10]."""
    known = load(spark, folder, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    size = known.count() * 8
    return load(spark, folder, "lineitem").join(F.broadcast(known) if size <= LISTED_BYTES else known, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def newest_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id is among the newest ids of each customer and status [J15]."""
    o = load(spark, folder, "orders")
    newest = o.groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return o.join(newest, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


def latest_or_any(spark: SparkSession, folder: str) -> DataFrame:
    """Of each user the newest reported value, or any where the newest has no time [A9 A10]."""
    rows = load(spark, folder, "kite_status_normalized").select(clean_user("userid").alias("userid"), instant_ms("timestamp").alias("ms"), plain("properties__os").alias("os"), "messageid").filter("userid IS NOT NULL")
    return rows.groupBy("userid").agg(F.coalesce(F.max_by("os", F.when(F.col("os").isNotNull() & F.col("ms").isNotNull(), F.struct("ms", "messageid"))), F.min("os")).alias("os"), F.count(F.lit(1)).alias("n"))


def customers_without_large_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers less those with an order above a price, and less those of a set of keys [J4 U2]."""
    large = load(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    c = load(spark, folder, "customer").select("c_custkey")
    return c.join(large, "c_custkey", "left_anti").subtract(load(spark, folder, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


def weekly_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per user and week beside the month's and the year's so far [A43 J11]."""
    e = load(spark, folder, "events").select("user_id", F.date_trunc("WEEK", "ts").cast("date").alias("week"), F.date_trunc("MONTH", "ts").cast("date").alias("month"), F.col("value"))
    weeks = e.groupBy("user_id", "month", "week").agg(F.round(F.sum("value"), 3).alias("week_total"), F.sum("value").alias("_v"))
    by = Window.partitionBy("user_id")
    return weeks.select("user_id", "month", "week", "week_total", F.round(F.sum("_v").over(by.partitionBy("user_id", "month")), 3).alias("month_total"), F.round(F.sum("_v").over(by.orderBy("week", "month").rowsBetween(Window.unboundedPreceding, 0)), 3).alias("so_far"))


def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Completions by source beside a derived total, and the total without the largest source [A42 A21 J6]."""
    rows = load(spark, folder, "kite_status_normalized").select(clean_user("userid").alias("userid"), F.explode("properties__completions_shown_by_source").alias("source", "n")).filter("userid IS NOT NULL")
    sums = rows.groupBy("userid", "source").agg(F.sum("n").alias("n")).groupBy("userid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return sums.select("userid", map_text(F.col("m")).alias("by_source"), total.alias("total"), (total - F.coalesce(F.array_max(F.map_values("m")), F.lit(0))).alias("without_largest"))


def expanded_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A map from order counts to customers, expanded back to a row per customer, with bounds padded by one [A44]."""
    per = load(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    counts = per.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("c"))
    bounds = counts.agg((F.min("v") - 1).alias("low"), (F.max("v") + 1).alias("high"))
    return counts.select(F.explode(F.array_repeat("v", F.col("c"))).alias("v")).select("v", bounds.select("low").scalar().alias("low"), bounds.select("high").scalar().alias("high"))


def flag_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """P(return flag | ship mode of supplier and status), and with the level above: the status alone [A28 A27 W5]."""
    c = load(spark, folder, "lineitem").rollup("l_linestatus", "l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    low = c.filter("g = 0").select("l_linestatus", "l_suppkey", "l_returnflag", "n")
    high = low.groupBy("l_linestatus", "l_returnflag").agg(F.sum("n").alias("m"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("l_linestatus", "l_suppkey"))
    above = high.select("l_linestatus", "l_returnflag", (F.col("m") / F.sum("m").over(Window.partitionBy("l_linestatus"))).alias("q"))
    return low.withColumn("p", p).join(above, ["l_linestatus", "l_returnflag"]).select("l_linestatus", "l_suppkey", "l_returnflag", "n", F.round("p", 6).alias("p"), F.round("q", 6).alias("p_above"))


def value_spread_by_version(spark: SparkSession, folder: str, least: int = 20) -> DataFrame:
    """Variance of users' means and nearest-rank percentiles by client version, for versions with enough users [A37 A13 A14]."""
    rows = load(spark, folder, "kite_status_normalized").select(clean_user("userid").alias("u"), F.substring_index("properties__client_version", ".", 1).alias("version"), F.col("properties__completions_shown").cast("double").alias("x")).filter("u IS NOT NULL AND version IS NOT NULL AND x IS NOT NULL")
    users = rows.groupBy("version", "u").agg(F.round(F.avg("x"), 6).alias("m"))
    w = Window.partitionBy("version")
    placed = users.withColumns({"n": F.count(F.lit(1)).over(w), "i": F.row_number().over(w.orderBy("m", "u"))}).filter(F.col("n") >= least)
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * p), F.col("n") - 1) + 1, F.col("m")))
    return placed.groupBy("version").agg(F.count(F.lit(1)).alias("users"), F.round(F.var_samp("m"), 4).alias("variance"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in all texts, one level deep: ``doc_id, func, args``."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_.]*\([^()\n]*\)"), F.lit(0))
    c = load(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(found).alias("c"))
    args = F.regexp_replace("c", r"^[^(]*\(|\)$", "")
    return c.select("doc_id", F.substring_index("c", "(", 1).alias("func"), F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(args, ","), lambda a: F.trim(a))).alias("args"))


def _keyword(a: Column) -> Column:
    return F.nullif(F.regexp_extract(a, r"^([A-Za-z_][A-Za-z0-9_]*)\s*=[^=]", 1), F.lit(""))


def signature_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by function and shape (number of plain arguments, sorted keywords) with counts, the commonest first argument [A30 A32]."""
    c = _calls(spark, folder)
    shaped = c.select("doc_id", "func", F.size(F.filter("args", lambda a: _keyword(a).isNull())).alias("arity"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("args", _keyword)))), ",").alias("keywords"), F.coalesce(F.try_element_at("args", F.lit(1)), F.lit("")).alias("first"))
    firsts = shaped.groupBy("func", "arity", "keywords", "first").agg(F.count(F.lit(1)).alias("k"))
    best = firsts.groupBy("func", "arity", "keywords").agg(F.sum("k").alias("n"), F.min_by("first", F.struct(-F.col("k"), F.col("first"))).alias("first"))
    return best.filter("n >= 2")


def method_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Of each package (the first name of a dotted call) its methods with counts, the commonest first [A29 A18]."""
    c = _calls(spark, folder).filter(F.contains("func", F.lit("."))).select(F.substring_index("func", ".", 1).alias("package"), F.substring_index("func", ".", -1).alias("method")).filter("package <> '' AND method <> ''")
    n = c.groupBy("package", "method").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("method"))))
    return n.groupBy("package").agg(F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["method"], (-s["m"]).cast("string"))), ",").alias("methods"))


def keyword_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords in calls of functions that some text defines, less the arguments their definitions give a default, with the kinds of literal [A31 J4]."""
    head = F.regexp_extract_all("text", F.lit(r"(?m)^\s*def [A-Za-z_][A-Za-z0-9_]*\([^()\n]*\)"), F.lit(0))
    d = load(spark, folder, "documents").filter("text IS NOT NULL").select(F.explode(head).alias("h")).distinct()
    defined = d.select(F.regexp_extract("h", r"def ([A-Za-z_][A-Za-z0-9_]*)\(", 1).alias("func"), F.transform(F.split(F.regexp_replace("h", r"^[^(]*\(|\)$", ""), ","), lambda a: F.trim(a)).alias("args")).distinct()
    own = defined.select("func", F.explode("args").alias("a")).select("func", _keyword(F.col("a")).alias("key")).filter("key IS NOT NULL").distinct()
    used = _calls(spark, folder).select(F.substring_index("func", ".", -1).alias("func"), F.explode("args").alias("a")).select("func", _keyword(F.col("a")).alias("key"), F.trim(F.regexp_replace("a", r"^[^=]*=", "")).alias("v")).filter("key IS NOT NULL")
    kind = F.when(F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(F.col("v").rlike("^[\"']"), "string").when(F.col("v").isin("True", "False"), "boolean").when(F.col("v") == "None", "none").otherwise("other")
    return used.join(own, ["func", "key"], "left_anti").groupBy("func", "key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def dotted_names(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of dotted names, and with those of all names below them added up to each level [A34 T21]."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"), F.lit(0))
    n = load(spark, folder, "documents").filter("text IS NOT NULL").select(F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("name", r"\.")
    levels = n.select("n", (F.size(parts)).alias("deep"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), ".").alias("name"), i.alias("level")))).alias("p"))
    return levels.groupBy("p.name").agg(F.sum(F.when(F.col("p.level") == F.col("deep"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("with_below"))


def net_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of each part by votes for less votes against, in that order [M14 O1]."""
    v = load(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.count_if(F.col("l_returnflag") == "N") - F.count_if(F.col("l_returnflag") == "R")).alias("votes"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("votes"), "l_suppkey")))


def expected_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Of each customer the price with the highest expected revenue under a fixed model of demand, missing inputs imputed [M6 M5 M15]."""
    o = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.lit(1)) / 10.0).alias("x"))
    c = load(spark, folder, "customer").select("c_custkey").join(o, "c_custkey", "left")
    mean = o.agg(F.avg("x"))
    filled = c.withColumn("x", F.coalesce("x", mean.scalar()))
    b, w = PRICE_MODEL
    offers = F.array(*[F.struct(F.round(F.lit(p) / (1 + F.exp(-(b + F.col("x") + w * p))), 6).alias("revenue"), F.lit(-p).alias("p")) for p in PRICES])
    best = F.array_max(offers)
    return filled.select("c_custkey", F.round("x", 6).alias("x"), (-best["p"]).alias("price"), best["revenue"].alias("revenue"))


def type_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Of each order the likeliest priority by its lines' attributes: sums of log probabilities, outliers penalised, then softmax [M8 T13]."""
    li = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", "l_returnflag", "l_linestatus", F.month("l_shipdate").cast("string")).alias("attr"))
    o = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"))
    seen = li.join(o, "o_orderkey").groupBy("type", "attr").agg(F.count(F.lit(1)).alias("n"))
    probs = seen.withColumn("lp", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("type")))).select("type", "attr", "lp")
    # what an attribute adds beyond the penalty; a type without it adds nothing. Types are few, attributes too
    gains = probs.select("type", "attr", (F.col("lp") - OUTLIER).alias("gain"))
    have = li.groupBy("o_orderkey", "attr").agg(F.count(F.lit(1)).alias("k"))
    size = li.groupBy("o_orderkey").agg((F.count(F.lit(1)) * OUTLIER).alias("base"))
    score = have.join(gains, "attr").groupBy("o_orderkey", "type").agg(F.sum(F.col("k") * F.col("gain")).alias("g")).join(size, "o_orderkey").select("o_orderkey", "type", (F.col("g") + F.col("base")).alias("s"))
    w = Window.partitionBy("o_orderkey")
    e = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return e.groupBy("o_orderkey").agg(F.min_by("type", F.struct(-F.round("p", 7), F.col("type"))).alias("type"), F.round(F.max("p"), 5).alias("p"))


def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    """The expected calibration error of a made score over ten bins [M11]."""
    o = load(spark, folder, "orders").select((F.col("o_totalprice") / 500000).alias("p"), F.col("o_orderpriority").startswith("1").cast("double").alias("y")).filter("p IS NOT NULL AND y IS NOT NULL")
    b = F.greatest(F.least(F.floor(F.col("p") * 10), F.lit(9)), F.lit(0)).cast("int")
    bins = o.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("error"))


def score_normals(spark: SparkSession, folder: str) -> DataFrame:
    """Part scores within a brand as softmax, z-score and share of the sum [T13]."""
    from millrace.operators.retrieval import normalised

    p = load(spark, folder, "part").select("p_partkey", "p_brand", (F.col("p_size") / 10.0).alias("s"))
    return normalised(p, ["p_brand"], "s").select("p_partkey", F.round("softmax", 6).alias("softmax"), F.round("z", 5).alias("z"), F.round("part", 6).alias("part"))


def normalised_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts through the normaliser: characters left, and a digest of what is left [T2 T3]."""
    t = X.normalise(F.col("text"))
    return load(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


def text_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """A text's length in bytes of UTF-8, units of UTF-16 and code points [T27]."""
    d = load(spark, folder, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.octet_length("text").alias("utf8"), (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("int").alias("utf16"), F.char_length("text").alias("utf32"))


def code_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Code tokens of all texts by kind: how many, and how many different ones [T8 T7]."""
    t = load(spark, folder, "documents").filter("text IS NOT NULL").select(F.explode(X.code_tokens(F.col("text"))).alias("t"))
    n = t.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(X.code_kind(F.col("t")).alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))


def unique_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's distinct lower-case words without those in over a fifth of the documents [T5]."""
    d = load(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w"))
    each = cut(d.select("doc_id", F.explode("w").alias("term")))
    many = d.agg(F.count(F.lit(1)) / 5).first()[0]
    stop = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > many).select("term")  # at most five times the words of a text
    return each.join(stop, "term", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.max("term").alias("last"))


def block_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The three commonest words of each block of a text between blank or one-character lines [T19 O2]."""
    d = load(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = d.withColumn("block", F.sum((F.length("t") <= 1).cast("bigint")).over(w)).filter(F.length("t") > 1)
    n = marked.select("doc_id", "block", F.explode(X.words(F.col("t"))).alias("word")).groupBy("doc_id", "block", "word").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy(F.desc("n"), "word"))
    return n.withColumn("place", order).filter("place <= 3")


def subtoken_index(spark: SparkSession, folder: str) -> DataFrame:
    """Of each piece of a name the names that hold it, the commonest first, then by the alphabet [T22 T4]."""
    names = load(spark, folder, "documents").filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+"), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    each = names.select("name", "n", F.explode(F.array_distinct(X.split_names(F.col("name")))).alias("piece"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("name"))))
    return each.groupBy("piece").agg(F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda s: s["name"]), ",").alias("names"))


def trigram_search(spark: SparkSession, folder: str) -> DataFrame:
    """A pattern searched over a trigram index: documents that all trigrams of its literal part list, then verified [T26]."""
    from millrace.operators.search import search, trigram_postings

    d = load(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    return search(d, trigram_postings(d, "doc_id", "text"), "doc_id", "text", r"return ([A-Za-z_]\w*)", "return ")


def field_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the cosine of raw-count tf-idf with a query in two fields, text and path, and by the words they share [M13 T12]."""
    from millrace.operators import retrieval as R

    terms = ["loader", "test", "data", "error", "return"]
    d = load(spark, folder, "documents")
    n = d.count()
    out = []
    for name, column in (("text", F.col("text")), ("path", F.regexp_replace("path", r"[^A-Za-z0-9]+", " "))):
        counts = R.term_counts(d.select("doc_id", X.words(column).alias("w")).filter("size(w) > 0"), "doc_id", "w")
        idf = R.idf(counts, "doc_id", n)
        v = counts.join(idf, "term").withColumn("w", F.col("c") * F.col("idf"))
        size = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        nq = idf.filter(F.col("term").isin(terms)).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))))
        hits = v.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("idf")).alias("dot"), F.count(F.lit(1)).alias("shared"))
        scored = hits.join(size, "doc_id").withColumn("nq", nq.scalar())
        out.append(scored.select("doc_id", F.lit(name).alias("field"), "shared", F.round(F.when((F.col("norm") < 1e-8) | (F.col("nq") < 1e-8), 0.0).otherwise(F.col("dot") / (F.col("norm") * F.col("nq"))), 6).alias("score")))
    both = out[0].unionByName(out[1])
    return both.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.sum("shared").alias("shared"), F.count(F.lit(1)).alias("fields"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        daily_schema_rollup, rollup_maps, fanned_out_totals, lines_of_known_parts, newest_by_id, latest_or_any, customers_without_large_orders, weekly_totals, source_totals, expanded_histogram, flag_probabilities,
        value_spread_by_version, signature_patterns, method_stats, keyword_arguments, dotted_names, net_votes, expected_revenue, type_estimates, calibration_error, score_normals, normalised_texts, text_offsets, code_token_counts,
        unique_terms, block_keywords, subtoken_index, trigram_search, field_scores,
    )
}

_USER = r"nullif(regexp_replace(userid, '[\x00-\x1F\x7F]', '', 'g'), '')"
_MS = r"CASE WHEN regexp_full_match(timestamp, '\d+') THEN try_cast(timestamp AS BIGINT) ELSE epoch_ms(try_cast(CASE WHEN regexp_matches(timestamp, '(Z|[+-]\d\d:\d\d)$') THEN timestamp ELSE timestamp || 'Z' END AS TIMESTAMPTZ)) END"
_PLAIN = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"


def _rolled_sql() -> str:
    out = []
    for c, kind in ROLLED.items():
        short = c.split("__", 1)[-1]
        if kind == "string":
            out += [f"arg_max({c}, (_ms, messageid)) FILTER ({c} IS NOT NULL) AS {short}__latest", f"count(DISTINCT {c}) AS {short}__different", f"count({c}) AS {short}__n"]
        elif kind == "boolean":
            out += [f"bool_or({c}) AS {short}__any", f"bool_and({c}) AS {short}__all", f"count(*) FILTER ({c}) AS {short}__true", f"round(CAST(count(*) FILTER ({c}) AS DOUBLE) / nullif(count({c}), 0), 6) AS {short}__part"]
        elif not kind.startswith("map"):
            out += [f"CASE WHEN count({c}) > 0 THEN round(CAST(sum({c}) AS DOUBLE), 4) END AS {short}__sum", f"CAST(min({c}) AS DOUBLE) AS {short}__min", f"CAST(max({c}) AS DOUBLE) AS {short}__max", f"round(avg({c}), 6) AS {short}__mean", f"CASE WHEN count({c}) > 0 THEN count(*) FILTER ({c} > 0) END AS {short}__positive"]
    maps = [c for c, k in ROLLED.items() if k.startswith("map")]
    joins, cols = "", ""
    for c in maps:
        short = c.split("__", 1)[-1]
        joins += f" LEFT JOIN (SELECT userid, day, event, string_agg(k || ':' || v, ',' ORDER BY k) AS {short}__by_key FROM (SELECT userid, day, event, e.key AS k, CAST(sum(e.value) AS BIGINT) AS v FROM (SELECT userid, day, event, unnest(map_entries({c})) AS e FROM r) GROUP BY ALL) GROUP BY ALL) m_{short} ON m_{short}.userid = a.userid AND m_{short}.day = a.day AND m_{short}.event IS NOT DISTINCT FROM a.event"
        cols += f", {short}__by_key"
    return f"WITH r AS (SELECT *, CAST(make_timestamp_ms(_ms) AS DATE) AS day FROM (SELECT {_USER} AS userid, {_MS} AS _ms, {_PLAIN.format('event')} AS event, messageid, {', '.join(ROLLED)} FROM kite_status_normalized) WHERE userid IS NOT NULL AND _ms IS NOT NULL), a AS (SELECT userid, day, event, count(*) AS n, {', '.join(out)} FROM r GROUP BY userid, day, event) SELECT a.*{cols} FROM a{joins}"


def _maps_sql() -> str:
    parts = " ".join(f"LEFT JOIN (SELECT user_id, sum(n) AS n_{d}d, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS by_type_{d}d, arg_max(event_type, (n, event_type)) AS most_{d}d FROM (SELECT user_id, event_type, count(*) AS n FROM e WHERE day > DATE '{END}' - {d} AND day <= DATE '{END}' GROUP BY ALL) GROUP BY 1) w{d} USING (user_id)" for d in DAYS)
    return f"WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), u AS (SELECT DISTINCT user_id FROM e WHERE day > DATE '{END}' - {max(DAYS)} AND day <= DATE '{END}') SELECT user_id, {', '.join(f'CAST(n_{d}d AS BIGINT) AS n_{d}d, by_type_{d}d' for d in DAYS)}, most_28d FROM u {parts}"


_CALLS = r"""c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*\([^()\n]*\)')) AS c FROM documents),
b AS (SELECT doc_id, split_part(c, '(', 1) AS func, regexp_replace(c, '^[^(]*\(|\)$', '', 'g') AS a FROM c),
calls AS (SELECT doc_id, func, CASE WHEN trim(a, ' ') = '' THEN [] ELSE list_transform(string_split(a, ','), lambda x: trim(x, ' ')) END AS args FROM b)"""
_KEY = r"nullif(regexp_extract({}, '^([A-Za-z_][A-Za-z0-9_]*)\s*=[^=]', 1), '')"
_FIELD = """{f}c AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower({x}), '\\w+')) AS term FROM documents) GROUP BY ALL),
{f}i AS (SELECT term, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM {f}c GROUP BY 1),
{f}q AS (SELECT sqrt(sum(idf * idf)) AS nq FROM {f}i WHERE term IN ('loader', 'test', 'data', 'error', 'return')),
{f}s AS (SELECT doc_id, sum(CASE WHEN term IN ('loader', 'test', 'data', 'error', 'return') THEN c * idf * idf END) AS dot, count(*) FILTER (term IN ('loader', 'test', 'data', 'error', 'return')) AS shared, sqrt(sum(c * idf * c * idf)) AS norm FROM {f}c JOIN {f}i USING (term) GROUP BY 1 HAVING shared > 0),
{f}r AS (SELECT doc_id, shared, round(CASE WHEN norm < 1e-8 OR nq < 1e-8 THEN 0 ELSE dot / (norm * nq) END, 6) AS score FROM {f}s, {f}q)"""

SQL: dict[str, str] = {
    "daily_schema_rollup": _rolled_sql(),
    "rollup_maps": _maps_sql(),
    "fanned_out_totals": "WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines, sum(qty) AS qty, round(sum(o_totalprice), 2) AS price FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, c_nationkey, coalesce(orders, 0) AS orders, lines, qty, price FROM customer LEFT JOIN o ON o_custkey = c_custkey",
    "lines_of_known_parts": "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1",
    "newest_by_id": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey, o_orderstatus)",
    "latest_or_any": f"WITH r AS (SELECT {_USER} AS userid, {_MS} AS ms, {_PLAIN.format('properties__os')} AS os, messageid FROM kite_status_normalized) SELECT userid, coalesce(arg_max(os, (ms, messageid)) FILTER (os IS NOT NULL AND ms IS NOT NULL), min(os)) AS os, count(*) AS n FROM r WHERE userid IS NOT NULL GROUP BY 1",
    "customers_without_large_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "weekly_totals": "WITH w AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('week', ts) AS DATE) AS week, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, month, week, round(v, 3) AS week_total, round(sum(v) OVER (PARTITION BY user_id, month), 3) AS month_total, round(sum(v) OVER (PARTITION BY user_id ORDER BY week, month ROWS UNBOUNDED PRECEDING), 3) AS so_far FROM w",
    "source_totals": f"WITH e AS (SELECT {_USER} AS userid, unnest(map_entries(properties__completions_shown_by_source)) AS e FROM kite_status_normalized), s AS (SELECT userid, e.key AS k, CAST(sum(e.value) AS BIGINT) AS n FROM e WHERE userid IS NOT NULL GROUP BY ALL) SELECT userid, string_agg(k || ':' || coalesce(CAST(n AS VARCHAR), ''), ',' ORDER BY k) AS by_source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, CAST(coalesce(sum(n), 0) - coalesce(max(n), 0) AS BIGINT) AS without_largest FROM s GROUP BY 1",
    "expanded_histogram": "WITH p AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) SELECT v, (SELECT min(v) - 1 FROM p) AS low, (SELECT max(v) + 1 FROM p) AS high FROM p",
    "flag_probabilities": "WITH c AS (SELECT l_linestatus, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT l_linestatus, l_returnflag, sum(n) AS m FROM c GROUP BY ALL), a AS (SELECT l_linestatus, l_returnflag, m / sum(m) OVER (PARTITION BY l_linestatus) AS q FROM h) SELECT l_linestatus, l_suppkey, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_linestatus, l_suppkey), 6) AS p, round(q, 6) AS p_above FROM c JOIN a USING (l_linestatus, l_returnflag)",
    "value_spread_by_version": f"WITH r AS (SELECT {_USER} AS u, split_part(properties__client_version, '.', 1) AS version, CAST(properties__completions_shown AS DOUBLE) AS x FROM kite_status_normalized), m AS (SELECT version, u, round(avg(x), 6) AS m FROM r WHERE u IS NOT NULL AND version IS NOT NULL AND x IS NOT NULL GROUP BY ALL), l AS (SELECT version, count(*) AS n, var_samp(m) AS v, list_sort(list(m)) AS ms FROM m GROUP BY 1 HAVING n >= 20) SELECT version, n AS users, round(v, 4) AS variance, {', '.join(f'ms[CAST(least(floor(n * {p}), n - 1) AS INTEGER) + 1] AS p{k}' for k, p in ((50, 0.5), (90, 0.9), (99, 0.99)))} FROM l",
    "signature_patterns": f"WITH {_CALLS}, s AS (SELECT func, CAST(len(list_filter(args, lambda x: {_KEY.format('x')} IS NULL)) AS INTEGER) AS arity, array_to_string(list_sort(list_distinct(list_filter(list_transform(args, lambda x: {_KEY.format('x')}), lambda x: x IS NOT NULL))), ',') AS keywords, coalesce(args[1], '') AS first FROM calls), k AS (SELECT func, arity, keywords, first, count(*) AS k FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY func, arity, keywords ORDER BY k DESC, first) AS i, sum(k) OVER (PARTITION BY func, arity, keywords) AS n FROM k) SELECT func, arity, keywords, CAST(n AS BIGINT) AS n, first FROM o WHERE i = 1 AND n >= 2",
    "method_stats": f"WITH {_CALLS}, m AS (SELECT split_part(func, '.', 1) AS package, regexp_extract(func, '[^.]*$') AS method, count(*) AS n FROM calls WHERE contains(func, '.') GROUP BY ALL) SELECT package, CAST(sum(n) AS BIGINT) AS n, string_agg(method || ':' || n, ',' ORDER BY n DESC, method) AS methods FROM m WHERE package <> '' AND method <> '' GROUP BY 1",
    "keyword_arguments": f"""WITH {_CALLS}, h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^\\s*def [A-Za-z_][A-Za-z0-9_]*\\([^()\\n]*\\)')) AS h FROM documents), d AS (SELECT regexp_extract(h, 'def ([A-Za-z_][A-Za-z0-9_]*)\\(', 1) AS func, unnest(list_transform(string_split(regexp_replace(h, '^[^(]*\\(|\\)$', '', 'g'), ','), lambda x: trim(x, ' '))) AS a FROM h),
own AS (SELECT DISTINCT func, {_KEY.format('a')} AS key FROM d WHERE {_KEY.format('a')} IS NOT NULL), u AS (SELECT regexp_extract(func, '[^.]*$') AS func, unnest(args) AS a FROM calls), v AS (SELECT func, {_KEY.format('a')} AS key, trim(regexp_replace(a, '^[^=]*=', ''), ' ') AS v FROM u WHERE {_KEY.format('a')} IS NOT NULL)
SELECT func, key, CASE WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(v, '^["'']') THEN 'string' WHEN v IN ('True', 'False') THEN 'boolean' WHEN v = 'None' THEN 'none' ELSE 'other' END AS kind, count(*) AS n FROM v ANTI JOIN own USING (func, key) GROUP BY ALL""",
    "dotted_names": r"""WITH n AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+')) AS name FROM documents), c AS (SELECT string_split(name, '.') AS p, count(*) AS n FROM n GROUP BY 1), l AS (SELECT p, n, unnest(range(1, len(p) + 1)) AS i FROM c) SELECT array_to_string(p[1:i], '.') AS name, CAST(sum(CASE WHEN i = len(p) THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS with_below FROM l GROUP BY 1""",
    "net_votes": "WITH v AS (SELECT l_partkey, l_suppkey, count(*) FILTER (l_returnflag = 'N') - count(*) FILTER (l_returnflag = 'R') AS votes FROM lineitem GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_suppkey) AS INTEGER) AS place FROM v",
    "expected_revenue": f"WITH o AS (SELECT o_custkey, count(*) / 10.0 AS x FROM orders GROUP BY 1), c AS (SELECT c_custkey, coalesce(x, (SELECT avg(x) FROM o)) AS x FROM customer LEFT JOIN o ON o_custkey = c_custkey), r AS (SELECT c_custkey, x, CAST(p AS DOUBLE) AS price, round(p / (1 + exp(-({PRICE_MODEL[0]} + x + {PRICE_MODEL[1]} * p))), 6) AS revenue FROM c, (VALUES {', '.join(f'({p}::DOUBLE)' for p in PRICES)}) v(p)), n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY revenue DESC, price) AS i FROM r) SELECT c_custkey, round(x, 6) AS x, price, revenue FROM n WHERE i = 1",
    "type_estimates": f"WITH l AS (SELECT l_orderkey, concat_ws('-', l_returnflag, l_linestatus, month(l_shipdate)) AS attr FROM lineitem), s AS (SELECT o_orderpriority AS type, attr, count(*) AS n FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), p AS (SELECT type, attr, ln(n / sum(n) OVER (PARTITION BY type)) AS lp FROM s), t AS (SELECT DISTINCT type FROM s), x AS (SELECT l_orderkey, type, sum(coalesce(lp, {OUTLIER})) AS s, count(lp) AS met FROM l CROSS JOIN t LEFT JOIN p USING (type, attr) GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_orderkey)) AS e FROM x WHERE met > 0), r AS (SELECT l_orderkey, type, e / sum(e) OVER (PARTITION BY l_orderkey) AS p FROM e) SELECT l_orderkey AS o_orderkey, arg_min(type, (-round(p, 7), type)) AS type, round(max(p), 5) AS p FROM r GROUP BY 1",
    "calibration_error": "WITH b AS (SELECT greatest(least(floor(o_totalprice / 50000), 9), 0) AS b, count(*) AS n, abs(avg(o_totalprice / 500000) - avg(CAST(o_orderpriority LIKE '1%' AS INTEGER))) AS gap FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS error FROM b",
    "score_normals": "WITH s AS (SELECT p_partkey, p_brand, p_size / 10.0 AS s FROM part), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY p_brand)) AS e, stddev_pop(s) OVER (PARTITION BY p_brand) AS d, avg(s) OVER (PARTITION BY p_brand) AS m, sum(s) OVER (PARTITION BY p_brand) AS t FROM s) SELECT p_partkey, round(e / sum(e) OVER (PARTITION BY p_brand), 6) AS softmax, round(CASE WHEN d > 0 THEN (s - m) / d ELSE 0 END, 5) AS z, round(CASE WHEN t <> 0 THEN s / t ELSE 0 END, 6) AS part FROM e",
    "normalised_texts": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\[\]]', '', 'g'), '`s|`', '', 'g'), '([Ii])/([Oo])', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, replace(replace(regexp_replace(replace(t, '_', chr(2)), '[\p{P}+=<>]', ' ', 'g'), chr(1), '/'), chr(2), '_') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g') AS t FROM b) SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM c""",
    "text_offsets": r"SELECT doc_id, CAST(strlen(text) AS INTEGER) AS utf8, CAST(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INTEGER) AS utf16, CAST(length(text) AS INTEGER) AS utf32 FROM documents WHERE text IS NOT NULL",
    "code_token_counts": "WITH t AS (SELECT unnest(regexp_extract_all(text, '" + X.CODE_TOKEN.replace("'", "''") + "')) AS t FROM documents), n AS (SELECT t, count(*) AS n FROM t GROUP BY 1) SELECT CASE WHEN regexp_matches(t, '^(//|#)') THEN 'comment' WHEN regexp_matches(t, '^[\"''].+[\"'']$') THEN 'string' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'name' ELSE 'sign' END AS kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS different FROM n GROUP BY 1",
    "unique_terms": r"WITH e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM documents), s AS (SELECT term FROM e GROUP BY 1 HAVING count(*) > (SELECT count(*) / 5 FROM documents WHERE text IS NOT NULL)) SELECT doc_id, count(*) AS terms, max(term) AS last FROM e WHERE term NOT IN (SELECT term FROM s) GROUP BY 1",
    "block_keywords": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), b AS (SELECT *, CAST(sum(CAST(length(t) <= 1 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l), n AS (SELECT doc_id, block, word, count(*) AS n FROM (SELECT doc_id, block, unnest(regexp_extract_all(lower(t), '\w+')) AS word FROM b WHERE length(t) > 1) GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, word) AS INTEGER) AS place FROM n) SELECT * FROM p WHERE place <= 3",
    "subtoken_index": r"WITH m AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+')) AS name FROM documents) GROUP BY 1), p AS (SELECT DISTINCT name, n, unnest(regexp_extract_all(lower(replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '_', ' ')), '[\p{L}\p{N}]+')) AS piece FROM m) SELECT piece, CAST(sum(n) AS BIGINT) AS n, string_agg(name, ',' ORDER BY n DESC, name) AS names FROM p GROUP BY 1",
    "trigram_search": r"SELECT doc_id, CAST(len(regexp_extract_all(text, 'return ([A-Za-z_]\w*)')) AS INTEGER) AS hits FROM documents WHERE regexp_matches(text, 'return ([A-Za-z_]\w*)')",
    "field_scores": "WITH " + ", ".join((_FIELD.format(f="t", x="text"), _FIELD.format(f="p", x="regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')"))) + " SELECT doc_id, round(sum(score), 6) AS score, CAST(sum(shared) AS BIGINT) AS shared, count(*) AS fields FROM (SELECT * FROM tr UNION ALL SELECT * FROM pr) GROUP BY 1",
}
