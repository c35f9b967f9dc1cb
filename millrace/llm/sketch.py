"""Distinct counts from bit matrices of hash ranks (problem 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Rows of a matrix; the relative standard error is about 0.65 / sqrt(rows), 1 % for 4096.
ROWS = 4096
#: Ranks kept, from 0; a set would need about ROWS * 2**RANKS members to fill them.
RANKS = 40
#: Up to so many characters the list of groups to count again is sent to all executors.
LISTED_CHARACTERS = 8_000_000


def bit_matrices(rows: DataFrame, groups: list[str | Column], member: str | Column, n_rows: int = ROWS) -> DataFrame:
    """A mergeable sketch per group: ``groups..., cell, bits``, one row per matrix row that isn't empty.

    A member's hash picks a matrix row at random (stochastic averaging) and, by its trailing zeros, a rank whose bit is
    set in that row. Setting a bit twice changes nothing, so repeats don't count, parts may overlap, and sketches merge
    by bitwise union. Spark unites the bits before and after the shuffle, so a group with a third of all rows sends
    at most ``n_rows`` rows from each partition. Null members are skipped; null group values are groups.
    """
    h = F.xxhash64(member if isinstance(member, Column) else F.col(member))
    rest = F.shiftrightunsigned(h, int(np.log2(n_rows)))
    # the lowest set bit of the rest alone is the bit of its rank; past the last rank the last bit
    bit = F.when(rest.bitwiseAND(F.lit((1 << RANKS) - 1)) == 0, F.lit(1 << (RANKS - 1))).otherwise(rest.bitwiseAND(-rest))
    named = [g if isinstance(g, Column) else F.col(g) for g in groups]
    kept = rows.filter((member if isinstance(member, Column) else F.col(member)).isNotNull())
    return kept.groupBy(*named, h.bitwiseAND(F.lit(n_rows - 1)).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Union the sketches of coarser groups, or of several days, partitions or runs."""
    return sketches.groupBy(*groups, "cell").agg(F.bit_or("bits").alias("bits"))


def cube(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Union the sketches of every combination of ``groups``; ``level`` is Spark's grouping id, absent values are null."""
    every = []
    for mask in range(1 << len(groups)):
        every.append(F.struct(F.lit(mask).alias("level"), *[(F.lit(None).cast(sketches.schema[g].dataType) if mask >> i & 1 else F.col(g)).alias(g) for i, g in enumerate(reversed(groups))]))
    spread = sketches.select(F.explode(F.array(*every)).alias("g"), "cell", "bits").select("g.*", "cell", "bits")
    return spread.groupBy("level", *groups, "cell").agg(F.bit_or("bits").alias("bits"))


def likelihood_estimate(counts: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood sizes and their standard errors from counts of set bits per rank, one set per line.

    With n members the bits are close to independent, rank j of a row being set with probability
    ``1 - exp(-n q_j)``, ``q_j = 2**-(j+1) / rows`` (twice the last one at the last rank). The log-likelihood is concave
    in n; its root is found by bisection on a logarithmic scale. The variance is the inverse of the Fisher information,
    less n: the bits are independent only if the number of members itself varies as a Poisson number, which it doesn't.
    """
    s = np.asarray(counts, dtype=float)
    q = 2.0 ** -(np.arange(RANKS) + 1) / n_rows
    q[-1] *= 2
    unset = ((n_rows - s) * q).sum(1)

    def slope(n: np.ndarray) -> np.ndarray:
        return (s * q / np.expm1(np.minimum(n[:, None] * q, 700))).sum(1) - unset

    low, high = np.full(len(s), -3.0), np.full(len(s), np.log(n_rows) + RANKS * np.log(2))
    for _ in range(60):
        mid = (low + high) / 2
        up = slope(np.exp(mid)) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    n = np.where(s.sum(1) == 0, 0.0, np.exp((low + high) / 2))
    x = np.minimum(np.maximum(n, 1e-9)[:, None] * q, 700)
    information = (n_rows * q * q * np.exp(-x) / -np.expm1(-x)).sum(1)
    return n, np.where(n > 0, np.sqrt(np.maximum(1 / np.maximum(information, 1e-300) - n, 0.0)), 0.0)


def estimate(sketches: DataFrame, groups: list[str], n_rows: int = ROWS) -> DataFrame:
    """``groups..., estimate, std_error`` of each group's sketch.

    The set bits of each rank are counted inside the JVM; Python sees one row of counts per group.
    """
    counted = sketches.groupBy(*groups).agg(F.array(*[F.sum(F.shiftright("bits", j).bitwiseAND(F.lit(1))) for j in range(RANKS)]).alias("_ranks"))

    @F.pandas_udf("estimate double, std_error double")
    def solve(ranks: pd.Series) -> pd.DataFrame:
        n, e = likelihood_estimate(np.array(ranks.tolist(), dtype=float).reshape(-1, RANKS), n_rows)
        return pd.DataFrame({"estimate": n, "std_error": e})

    return counted.withColumn("_e", solve("_ranks")).select(*groups, "_e.estimate", "_e.std_error")


def distinct_counts(rows: DataFrame, groups: list[str], member: str, n_rows: int = ROWS) -> DataFrame:
    """Distinct members per group and combination of groups: ``level, groups..., estimate, std_error, low, high``.

    ``level`` has bit i set (from the last group) where that group is summed up, as Spark's grouping id has. ``low`` and
    ``high`` are three standard errors away, never below zero. Rows with a null member don't count; a null group value
    is a group of its own (told from "all" by ``level``); repeats change nothing; an empty input gives no rows.
    """
    solved = estimate(cube(bit_matrices(rows.select(*groups, member), groups, member, n_rows), groups), ["level", *groups], n_rows)
    return solved.withColumn("low", F.greatest(F.lit(0.0), F.col("estimate") - 3 * F.col("std_error"))).withColumn("high", F.col("estimate") + 3 * F.col("std_error"))


def doubled(rows: DataFrame, day: str, group: str, member: str, factor: float = 2.0, bounds: float = 6.0, n_rows: int = ROWS) -> DataFrame:
    """The ``(day, group)`` with at least ``factor`` times as many distinct members as on the day before.

    Sketches decide: a pair of days whose bounds (``bounds`` standard errors and 2 members) lie wholly on one side of
    ``factor`` is settled by them, ``members`` and ``members_before`` then being the rounded estimates. Only the pairs
    whose bounds leave it open are counted again, exactly, and ``recounted`` says so. The list of days and groups to
    count again is sent to all tasks up to LISTED_CHARACTERS, so other rows never reach a shuffle; a longer one is
    joined. ``day`` is a date; null days, groups and members are skipped; a day without the group is no day before.
    """
    usable = rows.filter(F.col(day).isNotNull() & F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(day).alias("_d"), F.col(group).alias("_g"), F.col(member).alias("_m"))
    sized = cut(estimate(bit_matrices(usable, ["_d", "_g"], "_m", n_rows), ["_d", "_g"], n_rows))
    slack = F.lit(bounds) * F.col("std_error") + 2
    today = sized.select("_d", "_g", F.col("estimate").alias("_n"), (F.col("estimate") - slack).alias("_low"), (F.col("estimate") + slack).alias("_high"))
    before = sized.select(F.date_add("_d", 1).alias("_d"), "_g", F.col("estimate").alias("_b"), (F.col("estimate") - slack).alias("_least"), (F.col("estimate") + slack).alias("_most"))
    pairs = cut(today.join(before, ["_d", "_g"]).filter(F.col("_high") >= factor * F.col("_least")).withColumn("_sure", F.col("_low") >= factor * F.col("_most")))
    named = [F.col("_d").alias(day), F.col("_g").alias(group)]
    settled = pairs.filter("_sure").select(*named, F.round("_n").cast("bigint").alias("members"), F.round("_b").cast("bigint").alias("members_before"), F.lit(False).alias("recounted"))
    unsure = pairs.filter("NOT _sure").select("_d", "_g")
    needed = unsure.select(F.explode(F.array("_d", F.date_sub("_d", 1))).alias("_d"), "_g").distinct()
    size = needed.agg(F.sum(F.length(F.col("_g").cast("string")) + 10)).first()[0]
    if size is None:
        return settled
    listed = F.broadcast(needed) if size <= LISTED_CHARACTERS else needed
    exact = cut(usable.join(listed, ["_d", "_g"], "left_semi").distinct().groupBy("_d", "_g").agg(F.count(F.lit(1)).alias("_n")))
    earlier = exact.select(F.date_add("_d", 1).alias("_d"), "_g", F.col("_n").alias("_b"))
    counted = unsure.join(exact, ["_d", "_g"]).join(earlier, ["_d", "_g"]).filter(F.col("_n") >= factor * F.col("_b"))
    return settled.unionByName(counted.select(*named, F.col("_n").alias("members"), F.col("_b").alias("members_before"), F.lit(True).alias("recounted")))
