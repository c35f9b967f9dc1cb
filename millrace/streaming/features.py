"""Feature rows per entity kept by a stateful stream (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import exists, remove_dir, scratch_dir

#: The pseudo field that counts every message of an entity.
ANY = "*"
#: Folders of the store of feature rows; a batch writes anew the ones it touches. Take more for more entities.
BUCKETS = 32
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, on the executors' disks, with change logs in the checkpoint; the session's settings come back."""
    want = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table_stream(spark: SparkSession, folder: str, name: str, bytes_per_batch: int = 256 << 20) -> DataFrame:
    """A stream of the files of a Parquet table, be it a folder or one file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{folder}/{name}.parque[t]")


def counters(rows: DataFrame, entity: str, ms: str, message: str, fields: dict[str, str], totals: list[str]) -> DataFrame:
    """The stateful part: counters per entity, field and value of a stream (or a table) of messages.

    ``fields`` maps a field's name to the column with its value as text. The first state holds the message ids seen,
    so a message counts once, whenever it comes again. The second holds ``n``, ``last_ms`` and the sums of ``totals``
    per ``(entity, field, val)``; each batch is aggregated before it reaches the state, so a hot entity brings one row
    per value and input partition. Rows without entity or time don't count; rows without a message id count once per
    distinct content; null and empty values have no counter, the pseudo field ``*`` counts every message.
    """
    kept = rows.filter(F.col(entity).isNotNull() & F.col(ms).isNotNull())
    content = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in (entity, ms, *dict.fromkeys(fields.values()), *totals)]).cast("string"))
    slim = kept.select(F.col(entity).alias("entity"), F.col(ms).alias("_ms"), F.coalesce(F.col(message), content).alias("_id"), *[F.col(c).alias(f"_f_{i}") for i, c in enumerate(fields.values())], *[F.col(c).cast("bigint").alias(f"_t_{i}") for i, c in enumerate(totals)])
    once = slim.dropDuplicates(["_id"])
    values = F.array(F.struct(F.lit(ANY).alias("field"), F.lit("").alias("val")), *[F.struct(F.lit(name).alias("field"), F.col(f"_f_{i}").alias("val")) for i, name in enumerate(fields)])
    each = once.withColumn("_v", F.explode(values)).filter(f"_v.field = '{ANY}' OR _v.val <> ''")
    sums = [F.sum(F.coalesce(F.col(f"_t_{i}"), F.lit(0))).alias(name) for i, name in enumerate(totals)]
    return each.groupBy("entity", F.col("_v.field").alias("field"), F.col("_v.val").alias("val")).agg(F.count(F.lit(1)).alias("n"), F.max("_ms").alias("last_ms"), *sums)


def run_counters(stream: DataFrame, at: str, entity: str, ms: str, message: str, fields: dict[str, str], totals: list[str], rows_each_batch: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Run what the stream holds now through :func:`counters`; the counters as they then are.

    ``at`` is a folder all executors share. It holds the stream's checkpoint (state, offsets), the upserts of each
    batch under ``counters/batch=N`` and, with ``rows_each_batch``, the store of full feature rows (:func:`upsert_rows`),
    from which the result is then read. A batch that is run again after a failure overwrites its own folders, so each
    takes effect once; a later call with the same ``at`` goes on where this one ended.
    """
    spark = stream.sparkSession

    def upsert(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/counters/batch={batch}")
        if rows_each_batch:
            upsert_rows(changed.sparkSession, at, batch, list(fields), totals, buckets)

    with state_store(spark):
        query = counters(stream, entity, ms, message, fields, totals).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(upsert).trigger(availableNow=True).start()
        query.awaitTermination()
    if rows_each_batch:
        return long_form(current_rows(spark, at, list(fields), totals), list(fields), totals)
    schema = _counter_schema(totals) + ", batch int"
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], schema).drop("batch")
    return latest(spark.read.schema(schema).parquet(f"{at}/counters"), totals)


def _counter_schema(totals: list[str]) -> str:
    return "entity string, field string, val string, n bigint, last_ms bigint" + "".join(f", `{t}` bigint" for t in totals)


def _row_schema(fields: list[str], totals: list[str]) -> str:
    """Columns of a feature row: the entity's own counts, and per field a map from value to its counter."""
    own = ", ".join(["n bigint", "last_ms bigint", *[f"`{t}` bigint" for t in totals]])
    each = ", ".join(["n: bigint", "last_ms: bigint", *[f"`{t}`: bigint" for t in totals]])
    return f"entity string, {own}, " + ", ".join(f"`{f}` map<string, struct<{each}>>" for f in fields)


def _manifest(spark: SparkSession, at: str, batch: int) -> dict[int, int]:
    """For each bucket the batch that wrote its current rows, after ``batch``; at most one entry per bucket."""
    path = f"{at}/manifest/batch={batch}"
    if batch < 0 or not exists(spark, path):
        return {}
    return {r.bucket: r.wrote for r in spark.read.schema("bucket int, wrote int").json(path).collect()}


def upsert_rows(spark: SparkSession, at: str, batch: int, fields: list[str], totals: list[str], buckets: int = BUCKETS) -> None:
    """Bring the counters that ``batch`` changed into the keyed store of full feature rows, one row per entity.

    Rows lie in ``buckets`` folders by a hash of the entity. A batch reads and writes anew only the buckets it touches,
    under ``rows/batch=N``; the manifest of the batch says which folder is current for each bucket. Folders that no
    manifest but one older than the last names are deleted. A batch reads what the batches before it wrote, so it may
    run again. An entity has one row, so a hot one weighs no more than others.
    """
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")
    changed = spark.read.schema(_counter_schema(totals)).parquet(f"{at}/counters/batch={batch}").withColumn("_bucket", bucket)
    before, held = _manifest(spark, at, batch - 2), _manifest(spark, at, batch - 1)
    for k, wrote in before.items():
        if held.get(k, wrote) != wrote:
            remove_dir(spark, f"{at}/rows/batch={wrote}/_bucket={k}")
    touched = sorted(r[0] for r in changed.select("_bucket").distinct().collect())
    fresh = _rows_of(changed, fields, totals, "_bucket")
    old = _stored(spark, at, {k: held[k] for k in touched if k in held}, fields, totals)
    if old is not None:
        own = [c for c in ("n", "last_ms", *totals)]
        both = old.select("entity", F.struct(*own, *fields).alias("_o")).join(fresh.select("entity", F.struct(*own, *fields).alias("_f")), "entity", "full_outer")
        fresh = both.select("entity", *[F.coalesce(f"_f.{c}", f"_o.{c}").alias(c) for c in own], *[_overlaid(F.col(f"_o.{f}"), F.col(f"_f.{f}")).alias(f) for f in fields], bucket.alias("_bucket"))
    fresh.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{at}/rows/batch={batch}")
    held.update(dict.fromkeys(touched, batch))
    spark.createDataFrame(sorted(held.items()), "bucket int, wrote int").coalesce(1).write.mode("overwrite").json(f"{at}/manifest/batch={batch}")
    spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("overwrite").json(f"{at}/newest")


def _overlaid(old: Column, new: Column) -> Column:
    """The entries of two maps; those of ``new`` count where both have the key."""
    keys = F.map_keys(new)
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)), new))


def _stored(spark: SparkSession, at: str, where: dict[int, int], fields: list[str], totals: list[str]) -> DataFrame | None:
    paths = [f"{at}/rows/batch={wrote}/_bucket={k}" for k, wrote in sorted(where.items())]
    return spark.read.schema(_row_schema(fields, totals)).parquet(*paths) if paths else None


def current_rows(spark: SparkSession, at: str, fields: list[str], totals: list[str]) -> DataFrame:
    """The full feature rows as the last batch left them: ``entity, n, last_ms, totals..., fields...``."""
    newest = spark.read.schema("batch int").json(f"{at}/newest").first().batch if exists(spark, f"{at}/newest") else -1
    rows = _stored(spark, at, _manifest(spark, at, newest), fields, totals)
    return spark.createDataFrame([], _row_schema(fields, totals)) if rows is None else rows


def long_form(rows: DataFrame, fields: list[str], totals: list[str]) -> DataFrame:
    """Feature rows as ``entity, field, val, n, last_ms, totals...``, with the pseudo field ``*`` for the entity itself."""
    own = F.struct("n", "last_ms", *totals)

    def entries(f: str) -> Column:
        have = F.coalesce(F.col(f), F.create_map().cast(rows.schema[f].dataType))
        return F.transform(F.map_entries(have), lambda e: F.struct(F.lit(f).alias("field"), e["key"].alias("val"), e["value"].alias("c")))

    each = [entries(f) for f in fields]
    whole = F.array(F.struct(F.lit(ANY).alias("field"), F.lit("").alias("val"), own.alias("c")))
    return rows.select("entity", F.explode(F.concat(whole, *each)).alias("_e")).select("entity", "_e.field", "_e.val", "_e.c.*")


def latest(log: DataFrame, totals: list[str]) -> DataFrame:
    """The newest upsert of each counter."""
    row = F.struct("n", "last_ms", *totals)
    newest = log.groupBy("entity", "field", "val").agg(F.max_by(row, F.col("batch")).alias("_r"))
    return newest.select("entity", "field", "val", "_r.*")


def feature_rows(counts: DataFrame, totals: list[str]) -> DataFrame:
    """One row per entity: message count, last time and totals, and per field a map from value to its counter.

    An entity has at most as many counters as there are kinds of values, so the maps stay small for a hot one too.
    """
    kinds = [r.field for r in counts.select("field").distinct().collect() if r.field != ANY]  # as many as the fields asked for
    return _rows_of(counts, sorted(kinds), totals)


def _rows_of(counts: DataFrame, kinds: list[str], totals: list[str], *by: str) -> DataFrame:
    whole = F.col("field") == ANY
    plain = [F.max(F.when(whole, F.col(c))).alias(c) for c in ("n", "last_ms", *totals)]
    entry = F.struct(F.col("val").alias("key"), F.struct("n", "last_ms", *totals).alias("value"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") == k, entry)))).alias(k) for k in kinds]
    return counts.groupBy(*by, "entity").agg(*plain, *maps)


def stream_features(spark: SparkSession, folder: str, name: str, prepare, entity: str, ms: str, message: str, fields: dict[str, str], totals: list[str], **options) -> DataFrame:
    """The feature rows of a whole table, run through the stream from its first file on in a scratch folder.

    Each batch upserts the full rows of the entities it touches; the result is the store after the last one.
    """
    stream, at = prepare(read_table_stream(spark, folder, name)), scratch_dir(spark)
    run_counters(stream, at, entity, ms, message, fields, totals, rows_each_batch=True, **options)
    return current_rows(spark, at, list(fields), totals)
