"""Hot keys, found by a cheap first pass, so that they can be split before the shuffle that would gather them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are split; any other has at most rows / HOT_KEYS rows. Their list takes some 12 bytes a key.
HOT_KEYS = 10_000


class HotKeys:
    """Which keys are split into how many ways, as hashes of keys; a cold key with a hot one's hash is split too."""

    def __init__(self, rows: DataFrame, key: Column, more_than: int, most: int = HOT_KEYS) -> None:
        """Count ``rows`` by the hash of ``key``; of the keys with more than ``more_than`` rows the ``most`` largest are hot."""
        counts = rows.groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
        top = counts.orderBy(F.desc("n"), "h").limit(most).collect()
        self.key, self.any = key, bool(top)
        self._table = F.broadcast(rows.sparkSession.createDataFrame([(r.h, ceil(r.n / more_than)) for r in top], "_hot bigint, _ways int")) if top else None

    def salted(self, rows: DataFrame, by: Column, name: str = "_salt") -> DataFrame:
        """``rows`` with the way of each: 0 for cold keys, else by the hash ``by``. No shuffle: the list is broadcast."""
        if not self.any:
            return rows.withColumn(name, F.lit(0))
        met = rows.join(self._table, F.xxhash64(self.key) == F.col("_hot"), "left")
        return met.withColumn(name, F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(by, F.col("_ways")).cast("int"))).drop("_hot", "_ways")

    def parted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of cold and of hot keys."""
        on = F.xxhash64(self.key) == F.col("_hot")
        return rows.join(self._table, on, "left_anti"), rows.join(self._table, on, "left_semi")
