"""Enrichment joins that aren't plain equalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_join(rows: DataFrame, number: str, blocks: DataFrame, base: str, bits: str, values: list[str]) -> DataFrame:
    """Each row with the values of the longest address block its number lies in; rows without one keep nulls.

    There are at most 33 block lengths. Each distinct number is tried at the lengths that occur, masked, and met with
    the blocks by equality on (length, masked base), which hashes and spreads like any equi-join; of the blocks met the
    longest counts, ties to the smallest values. Null numbers match nothing. Numbers that repeat are looked up once.
    """
    lengths = sorted(r[0] for r in blocks.select(bits).filter(F.col(bits).between(0, 32)).distinct().collect())  # 33 at most
    mask = {b: ((1 << 32) - 1) ^ ((1 << (32 - b)) - 1) for b in lengths}
    distinct = rows.select(F.col(number).alias("_n")).filter("_n IS NOT NULL").distinct()
    if not lengths:
        return rows.select("*", *[F.lit(None).cast(blocks.schema[v].dataType).alias(v) for v in values])
    tried = distinct.select("_n", F.explode(F.array(*[F.struct(F.lit(b).alias("_bits"), F.col("_n").bitwiseAND(F.lit(mask[b])).alias("_base")) for b in lengths])).alias("_t")).select("_n", "_t.*")
    masks = F.create_map(*[x for b in lengths for x in (F.lit(b), F.lit(mask[b]).cast("bigint"))])
    own = blocks.filter(F.col(bits).between(0, 32)).select(F.col(bits).alias("_bits"), F.col(base).bitwiseAND(masks[F.col(bits)]).alias("_base"), F.struct(*values).alias("_v"))
    best = tried.join(own, ["_bits", "_base"]).groupBy("_n").agg(F.min_by("_v", F.struct(-F.col("_bits"), F.col("_v"))).alias("_v"))
    return rows.join(best, F.col(number) == F.col("_n"), "left").select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
