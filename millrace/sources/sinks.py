"""Writers: rolled files, versioned snapshots, idempotent upserts, resumable deliveries, a log of runs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import exists, remove_dir


def write_rolled(rows: DataFrame, path: str, per_file: int, kind: str = "json", compression: str = "gzip", max_bytes: int | None = None) -> list[str]:
    """Files of at most ``per_file`` rows; ``_SUCCESS`` marks the end. Returns the files' names.

    With ``max_bytes`` a file also ends where its rows, as JSON before compression, would go beyond so many bytes; a
    single larger row has a file of its own.
    """
    if max_bytes is not None:
        size = F.octet_length(F.to_json(F.struct(*rows.columns))).cast("bigint") + 1
        # rows of a partition keep their order; each run of max_bytes has a folder
        placed = rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id(), "_z": size})
        w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        rows = placed.withColumn("_roll", F.concat_ws("-", "_p", ((F.sum("_z").over(w) - F.col("_z")) / F.greatest(F.lit(1), F.lit(max_bytes) - F.max("_z").over(Window.partitionBy("_p")))).cast("bigint").cast("string"))).drop("_p", "_i", "_z")
        rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).partitionBy("_roll").format(kind).save(path)
    else:
        rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).format(kind).save(path)
    return sorted(r.path for r in rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect())


def write_counted(rows: DataFrame, path: str, good: Column, kind: str = "json") -> dict[str, int]:
    """Write the good rows; how many were written, and how many weren't, counted as they pass."""
    seen = Observation()
    counted = rows.observe(seen, F.count_if(good).alias("written"), F.count_if(~F.coalesce(good, F.lit(False))).alias("errors"))
    counted.filter(good).write.mode("overwrite").format(kind).save(path)
    return dict(seen.get)


def write_partitioned(rows: DataFrame, path: str, *by: str, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Hive folders; rows of a folder are brought together first, so that it has few files. AQE splits large ones."""
    rows.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(kind).save(path)


def append_to(path: str, kind: str = "parquet") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch's rows under ``path/batch=N``; a batch that runs again overwrites its own."""
    return lambda batch, number: batch.write.mode("overwrite").format(kind).save(f"{path}/batch={number}")


class Snapshot:
    """A table of which whole new versions are written beside the old one; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[str]:
        try:
            return [r.version for r in self.spark.read.schema("version string, at double").json(f"{self.root}/pointer").orderBy("at").collect()]
        except Exception as e:  # noqa: BLE001  # no version yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def swap(self, rows: DataFrame) -> str:
        """Write ``rows`` (which may come from the current version) as the next version and point to it."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{version}")
        self.spark.createDataFrame([(version, time.time())], "version string, at double").coalesce(1).write.mode("append").json(f"{self.root}/pointer")
        return version

    def drop_old(self, keep: int = 1) -> list[str]:
        """Delete all versions but the newest ``keep``; readers of older ones must have ended. Returns what went."""
        gone = [v for v in self.versions()[:-keep] if exists(self.spark, f"{self.root}/{v}")]
        for v in gone:
            remove_dir(self.spark, f"{self.root}/{v}")
        return gone

    def read(self) -> DataFrame | None:
        own = self.versions()
        return self.spark.read.parquet(f"{self.root}/{own[-1]}") if own else None


def document_id(*parts: str):
    """A deterministic id of key parts, so that a row that is delivered again overwrites itself."""
    return F.md5(F.concat_ws("::", *[F.col(p).cast("string") for p in parts]))


def upsert_into(snapshot: Snapshot, ident: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows replace those of the same ``ident``; of several the one with the greatest ``order``.

    Each batch writes a whole new version; see :class:`KeyedStore` for large tables and small batches.
    """

    def run(batch: DataFrame, _: int) -> None:
        held = snapshot.read()
        rows = batch if held is None else held.unionByName(batch, allowMissingColumns=True)
        newest = rows.groupBy(ident).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")
        snapshot.swap(newest)

    return run


class KeyedStore:
    """Rows by ``ident`` in buckets by its hash; a batch writes anew only the buckets it touches, and may run again."""

    def __init__(self, spark: SparkSession, root: str, ident: str, order: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.root, self.ident, self.order, self.schema, self.buckets = spark, root.rstrip("/"), ident, order, schema, buckets

    def _where(self, batch: int) -> dict[int, int]:
        """The batch that wrote each bucket's current rows, after ``batch``: at most one entry per bucket."""
        path = f"{self.root}/manifest/batch={batch}"
        return {r.bucket: r.wrote for r in self.spark.read.schema("bucket int, wrote int").json(path).collect()} if batch >= 0 and exists(self.spark, path) else {}

    def _rows(self, where: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/rows/batch={b}/_bucket={k}" for k, b in sorted(where.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def upsert(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``, numbered from 0: of rows with one ident the one with the greatest order stays.

        Rows without ident or order are skipped.
        """
        bucket = F.pmod(F.xxhash64(self.ident), F.lit(self.buckets)).cast("int")
        kept = batch.filter(F.col(self.ident).isNotNull() & F.col(self.order).isNotNull()).persist()
        try:
            where = self._where(number - 1)
            touched = sorted(r[0] for r in kept.select(bucket.alias("b")).distinct().collect())
            old = self._rows({k: where[k] for k in touched if k in where})
            rows = kept if old is None else old.unionByName(kept)
            newest = rows.groupBy(self.ident).agg(F.max_by(F.struct(*rows.columns), F.col(self.order)).alias("_r")).select("_r.*").withColumn("_bucket", bucket)
            newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/rows/batch={number}")
        finally:
            kept.unpersist()
        where.update(dict.fromkeys(touched, number))
        self.spark.createDataFrame(sorted(where.items()), "bucket int, wrote int").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/batch={number}")

    def read(self, number: int) -> DataFrame:
        """All rows as batch ``number`` left them."""
        rows = self._rows(self._where(number))
        return self.spark.createDataFrame([], self.schema) if rows is None else rows


def deliver(rows: DataFrame, order: str, done: int, size: int, send: Callable[[list[dict]], None]) -> DataFrame:
    """Send rows numbered by ``order`` from ``done`` on in batches of ``size``; returns ``batch, rows`` sent.

    ``send`` runs in the executors, once per batch of a partition; a row's number tells a receiver what it has.
    """
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            sent = []
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size].to_dict("records")
                send(part)
                sent.append((int(part[0][order]), len(part)))
            yield pd.DataFrame(sent, columns=["first", "rows"])

    return rows.filter(F.col(order) >= done).repartitionByRange(F.col(order)).sortWithinPartitions(order).mapInPandas(run, "first bigint, rows bigint")


def log_run(spark: SparkSession, path: str, name: str, params: dict, results: dict, status: str = "done") -> None:
    """Append a run to the log of runs."""
    row = (uuid.uuid4().hex, name, time.time(), status, json.dumps(params, sort_keys=True), json.dumps(results, sort_keys=True))
    spark.createDataFrame([row], "run string, name string, at double, status string, params string, results string").coalesce(1).write.mode("append").json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All logged runs, the newest first."""
    return spark.read.schema("run string, name string, at double, status string, params string, results string").json(path).orderBy(F.desc("at"))
