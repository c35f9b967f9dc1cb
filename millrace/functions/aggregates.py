"""Aggregates and post-aggregates that built-in ones don't name, as column expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_true(flag: Column) -> Column:
    """Share of true among the non-null values; null if there is none."""
    return F.count_if(flag).cast("double") / F.nullif(F.count(flag), F.lit(0))


def count_positive(x: Column) -> Column:
    """Number of values above zero; null, not zero, if the value was never reported."""
    return F.when(F.count(x) > 0, F.count_if(x > 0))


def nearest_rank(x: Column, p: float) -> Column:
    """The value at position ``min(floor(n p), n - 1)`` of the sorted group, counted from 0; null for an empty group.

    Exact, so it holds a group's values: for groups of bounded size, such as a user's day. Use
    ``percentile_approx`` for others.
    """
    values = F.array_sort(F.collect_list(x))
    at = F.least(F.floor(F.count(x) * F.lit(p)), F.count(x) - 1).cast("int")
    return F.when(F.count(x) > 0, F.try_element_at(values, at + 1))


def latest(x: Column, *order: Column) -> Column:
    """The value of the row with the greatest order, null included."""
    return F.max_by(x, F.struct(*order))


def streak(units: Column, start: int = 0) -> Column:
    """Of a group's distinct unit numbers, how many follow each other from ``start`` on (0, 1, 2 ...)."""
    return F.aggregate(F.sort_array(F.collect_set(units)), F.lit(start), lambda a, u: F.when(u == a, a + 1).otherwise(a)) - start


def mode_by_weight(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """The value with most weight in each group, ties to the smallest value: ``group..., value, weight``."""
    sums = rows.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*group).agg(F.min_by(F.struct(value, "_w"), F.struct(-F.col("_w"), F.col(value))).alias("_b")).select(*group, F.col(f"_b.{value}").alias(value), F.col("_b._w").alias(weight))


def share(x: str, *by: str) -> Column:
    """A value's share of its group's sum."""
    from pyspark.sql import Window

    return F.col(x) / F.sum(x).over(Window.partitionBy(*by))


def argmax_name(names: list[str]) -> Column:
    """The name of the column with the largest value, ties to the first named; null if all are null."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(n).cast("double"), F.lit(float("-inf"))).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    return F.when(F.coalesce(*[F.col(n).cast("double") for n in names]).isNotNull(), best["n"])


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null unless it has four parts from 0 to 255."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("bigint"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p))
