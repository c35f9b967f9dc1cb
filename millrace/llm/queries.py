"""Queries of the training-data problems, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.clean import clean_user, instant_ms, plain, strip
from millrace.llm.mixing import measured, mix, parsed_for_mixing, share_report
from millrace.llm.packing import fill_report, pack, token_sizes
from millrace.llm.sketch import distinct_counts, doubled
from millrace.llm.subjects import MIN_UNITS, fit_from, parse_units, subject_units
from millrace.llm.terms import ngram_frequencies, value_frequencies
from millrace.session import cut
from millrace.tables import load


def _bare(tag: Column) -> Column:
    """A tag in lower case without surrounding white space and enclosing angle brackets."""
    inner = F.regexp_replace(strip(tag), r"(?s)^<(.*)>$", "$1")
    return F.nullif(F.lower(strip(inner)), F.lit(""))


def p1_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct tag with rows, distinct posts and mark."""
    tags = load(spark, folder, "tags").select(_bare(F.col("tag")).alias("tag"), "post_id")
    return value_frequencies(tags, "tag", "post_id").withColumnRenamed("records", "posts")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The tags that are too rare or too common."""
    return p1_tags(spark, folder).filter("mark <> 'useful'").select("tag", "mark")


def p1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every word and pair of words of all documents with rows, documents and mark."""
    return ngram_frequencies(load(spark, folder, "documents"), "doc_id", "text", longest=2)


def _active(spark: SparkSession, folder: str) -> DataFrame:
    raw = load(spark, folder, "kite_daily_active_users")
    country = F.upper(strip("country_iso_code"))
    day = F.date_from_unix_date(F.floor(instant_ms("timestamp") / 86_400_000).cast("int"))
    return raw.select(clean_user("userid").alias("userid"), day.alias("active_day"), F.when(country.rlike("^[A-Z]{2}$"), country).alias("country_iso_code"), plain("os").alias("os")).filter("userid IS NOT NULL AND active_day IS NOT NULL")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days and countries with at least twice as many users as the day before."""
    found = doubled(_active(spark, folder), "active_day", "country_iso_code", "userid")
    return found.select(F.col("active_day").cast("string").alias("active_day"), "country_iso_code")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated users per day, country, OS and combination, with their bounds."""
    return distinct_counts(_active(spark, folder), ["active_day", "country_iso_code", "os"], "userid").withColumn("active_day", F.col("active_day").cast("string"))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every text or piece of one with its container, for each kind of container."""
    sizes = cut(token_sizes(load(spark, folder, "documents")))
    kinds = load(spark, folder, "pack_capacities").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    packed = pack(sizes, kinds)
    return packed.select(F.col("kind").alias("container_kind"), F.col("capacity").alias("capacity_tokens"), F.col("container").alias("container_id"), "doc_id", "piece", "tokens")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full each kind's containers are."""
    packed = p8_packing(spark, folder).withColumnsRenamed({"container_kind": "kind", "capacity_tokens": "capacity", "container_id": "container"})
    return fill_report(packed)


def _parsed(documents: DataFrame) -> DataFrame:
    return cut(parse_units(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents with their copies."""
    documents = load(spark, folder, "documents")
    parsed = cut(parsed_for_mixing(documents))
    model = fit_from(load(spark, folder, "subject_examples"), documents, parsed=parsed)
    return mix(cut(measured(documents, model, parsed=parsed)), load(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of tokens wanted and reached."""
    return share_report(p9_mix(spark, folder), load(spark, folder, "mix_targets"))


def _subject_units(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    parsed = _parsed(documents)
    return subject_units(documents, fit_from(load(spark, folder, "subject_examples"), documents, parsed=parsed), parsed=parsed)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject that at least two units of a text are about."""
    return _subject_units(spark, folder).filter(F.col("units") >= MIN_UNITS).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents about it, documents that mention it, and units."""
    return _subject_units(spark, folder).groupBy("subject").agg(F.count_if(F.col("units") >= 2).alias("documents"), F.count(F.lit(1)).alias("mentions"), F.sum("units").alias("units"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_tags, p1_ngrams, p6_found, p6_counts, p8_packing, p8_report, p9_mix, p9_shares, p10_found, p10_composition)}

_TAGS = r"""WITH t AS (SELECT nullif(lower(regexp_replace(regexp_replace(regexp_replace(tag, '^\s+|\s+$', '', 'g'), '^<(.*)>$', '\1', 's'), '^\s+|\s+$', '', 'g')), '') AS tag, post_id FROM tags),
p AS (SELECT count(DISTINCT post_id) AS n FROM t),
m AS (SELECT tag, count(*) AS rows, count(DISTINCT post_id) AS posts FROM t WHERE tag IS NOT NULL GROUP BY tag),
r AS (SELECT tag, rows, posts, CASE WHEN posts < 3 THEN 'rare' WHEN posts > 0.05 * n THEN 'common' ELSE 'useful' END AS mark FROM m, p)"""
_GRAMS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(w) AS ngram, 1 AS n FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w),
d AS (SELECT count(DISTINCT doc_id) AS docs FROM documents),
c AS (SELECT ngram, CAST(n AS INTEGER) AS n, count(*) AS rows, count(DISTINCT doc_id) AS records FROM g GROUP BY ALL)
SELECT ngram, n, rows, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * docs THEN 'common' ELSE 'useful' END AS mark FROM c, d"""
_USER = r"nullif(regexp_replace(userid, '[\x00-\x1F\x7F]', '', 'g'), '')"
_MS = r"CASE WHEN regexp_full_match(timestamp, '\d+') THEN try_cast(timestamp AS BIGINT) ELSE epoch_ms(try_cast(CASE WHEN regexp_matches(timestamp, '(Z|[+-]\d\d:\d\d)$') THEN timestamp ELSE timestamp || 'Z' END AS TIMESTAMPTZ)) END"

SQL: dict[str, str] = {
    "p1_found": f"{_TAGS} SELECT tag, mark FROM r WHERE mark <> 'useful'",
    "p1_tags": f"{_TAGS} SELECT * FROM r",
    "p1_ngrams": _GRAMS,
    "p6_found": rf"""WITH a AS (SELECT {_USER} AS userid, CAST(make_timestamp_ms({_MS}) AS DATE) AS day, upper(regexp_replace(country_iso_code, '^\s+|\s+$', '', 'g')) AS c FROM kite_daily_active_users),
n AS (SELECT day, c, count(DISTINCT userid) AS n FROM a WHERE userid IS NOT NULL AND day IS NOT NULL AND regexp_full_match(c, '[A-Z][A-Z]') GROUP BY day, c)
SELECT CAST(x.day AS VARCHAR) AS active_day, x.c AS country_iso_code FROM n x JOIN n y ON x.c = y.c AND y.day = x.day - 1 WHERE x.n >= 2 * y.n""",
}
