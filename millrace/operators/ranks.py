"""Exact order statistics without a global sort in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def cumulative_counts(rows: DataFrame, value: str, buckets: int = 200) -> DataFrame:
    """Each distinct value with its rank range: ``value, lo, hi``; positions ``lo`` to ``hi - 1`` of the sorted rows hold it.

    Equal values are counted first, so a frequent one is a single row. Values are dealt into buckets between
    approximate quantiles; counts of whole buckets (at most ``buckets + 1`` numbers) go to the driver, and running sums are
    taken inside each bucket. Nulls are skipped.
    """
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")))  # read three times
    cuts = counts.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    placed = counts.withColumn("_b", at)
    sizes = {r["_b"]: r["n"] for r in placed.groupBy("_b").agg(F.sum("_c").alias("n")).collect()}
    starts = dict(zip(sorted(sizes), accumulate([0, *[sizes[b] for b in sorted(sizes)]])))
    if not starts:
        return counts.select(value, F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"))
    offset = F.create_map(*[x for b, s in starts.items() for x in (F.lit(b), F.lit(s).cast("bigint"))])[F.col("_b")]
    run = F.sum("_c").over(Window.partitionBy("_b").orderBy(value))
    return placed.select(value, (offset + run - F.col("_c")).alias("lo"), (offset + run).alias("hi"))


def at_positions(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """The nearest-rank values at ``shares``: ``nth`` (its place in the list, from 1) and the value; no rows for no input."""
    ranks = cut(cumulative_counts(rows, value))
    n = ranks.agg(F.max("hi")).first()[0] or 0
    wanted = [(i, min(int(n * s + 1e-9), n - 1)) for i, s in enumerate(shares, 1)]
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(p).cast("bigint").alias("at")) for i, p in wanted]), lambda w: (w["at"] >= F.col("lo")) & (w["at"] < F.col("hi")))
    return ranks.select(F.explode(hits).alias("w"), value).select("w.nth", value)
