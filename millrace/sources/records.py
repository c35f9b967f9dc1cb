"""Readers: key-value records, events as JSON lines, CSV with inferred values, archives of repositories, date ranges."""

from __future__ import annotations

import base64
import io
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of unpacked files that are passed on at once.
ARCHIVE_CHUNK = 64 << 20
KV = "key string, tag int, value binary"


def read_kv(spark: SparkSession, path: str, tagged: bool = False) -> DataFrame:
    """Lines of ``key <tab> base64url(zlib(value))``; with ``tagged`` a byte and an int32 before the value.

    Lines that don't decode have a null value, so that they can be counted and looked at.
    """
    lines = spark.read.text(path).withColumn("p", F.split("value", "\t", 2)).select(F.col("p")[0].alias("key"), F.try_element_at("p", F.lit(2)).alias("blob"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_decode(b, tagged) for b in pdf["blob"]]
            yield pd.DataFrame({"key": pdf["key"], "tag": pd.array([t for t, _ in found], dtype="Int32"), "value": [v for _, v in found]})

    return lines.mapInPandas(decode, KV)


def _decode(blob: str | None, tagged: bool) -> tuple[int | None, bytes | None]:
    try:
        raw = zlib.decompress(base64.urlsafe_b64decode(blob))
        return (struct.unpack(">i", raw[1:5])[0], raw[5:]) if tagged else (None, raw)
    except (TypeError, ValueError, zlib.error, struct.error):
        return None, None


def write_kv(rows: DataFrame, path: str, key: str, value: str, tag: str | None = None) -> None:
    """The lines :func:`read_kv` reads; keys are trimmed, values may be text or bytes."""
    given = rows.select(F.trim(F.col(key).cast("string")).alias("key"), F.col(value).cast("binary").alias("value"), (F.col(tag).cast("int") if tag else F.lit(None).cast("int")).alias("tag"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            head = [b"" if tag is None else b"\x01" + struct.pack(">i", int(t)) for t in pdf["tag"]]
            yield pd.DataFrame({"value": [f"{k or ''}\t{base64.urlsafe_b64encode(zlib.compress(h + bytes(v or b''))).decode()}" for k, h, v in zip(pdf["key"], head, pdf["value"])]})

    given.mapInPandas(encode, "value string").write.mode("overwrite").text(path)


class DecodeBudget(ValueError):
    """More undecodable records than allowed."""


def read_events(spark: SparkSession, paths: str | list[str], schema: str, names: list[str] | None = None, max_errors: int | None = None) -> DataFrame:
    """JSON lines with a declared schema; the column ``_corrupt`` holds lines that don't parse.

    ``names`` keeps events of these names. ``max_errors`` is a budget: more corrupt lines raise :class:`DecodeBudget`.
    """
    own = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    events = spark.read.text(paths).filter("trim(value) <> ''").select(F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    if max_errors is not None:
        bad = events.filter("_corrupt IS NOT NULL").limit(max_errors + 1).count()
        if bad > max_errors:
            raise DecodeBudget(f"more than {max_errors} records don't decode")
    return events.filter(F.col("event").isin(names)) if names else events


def inferred(c: Column) -> Column:
    """The kind of value a CSV text holds: boolean, int, float, time or string; null for an empty one."""
    t = F.trim(c)
    return F.when(c.isNull() | (t == ""), F.lit(None).cast("string")).when(F.lower(t).isin("true", "false"), "boolean").when(t.try_cast("bigint").isNotNull() & t.rlike(r"^[+-]?\d+$"), "int").when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "float").when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & t.try_cast("timestamp").isNotNull(), "time").otherwise("string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line; all columns are texts unless a schema is given, empty ones null."""
    reader = spark.read.option("header", True).option("nullValue", "").option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_archives(spark: SparkSession, path: str, max_bytes: int | None = None, endings: tuple[str, ...] = ()) -> DataFrame:
    """The files inside ``*.tar.gz`` archives of repositories: ``archive, name, size, contents``.

    Files of other ``endings``, or beyond ``max_bytes`` where that is given, keep their name and size without contents.
    Archives are read one by one inside the executors, files in chunks; one that can't be read gives a row without a name.
    """
    columns = ["archive", "name", "size", "contents"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, blob in zip(pdf["path"], pdf["content"]):
                rows: list[tuple] = []
                held = 0
                try:
                    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as tar:
                        for m in tar:
                            if m.isfile():
                                keep = (max_bytes is None or m.size <= max_bytes) and (not endings or m.name.endswith(endings))
                                rows.append((archive, m.name, m.size, tar.extractfile(m).read().decode("utf-8", "replace") if keep else None))
                                held += m.size if keep else 0
                                if held > ARCHIVE_CHUNK:  # an archive may be much larger unpacked
                                    yield pd.DataFrame(rows, columns=columns)
                                    rows, held = [], 0
                except (tarfile.TarError, OSError, EOFError):
                    rows.append((archive, None, None, None))
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path", "content").mapInPandas(unpack, "archive string, name string, size bigint, contents string")


def read_files(spark: SparkSession, path: str, endings: tuple[str, ...] = ()) -> DataFrame:
    """One row per file below a folder: ``path, text``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.filter(F.regexp_extract("path", r"(\.\w+)$", 1).isin(*endings)) if endings else files


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; partitioning options (``partitionColumn``, bounds, ``numPartitions``) pass through."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def prefixes(start: date, end: date, hours: int = 1, late_hours: int = 0) -> list[str]:
    """Landing folders ``yyyy/MM/dd/HH`` from ``start`` to the end of ``end``, and as many hours more for late rows."""
    at, out = 0, []
    last = ((end - start).days + 1) * 24 + late_hours
    while at < last:
        d = start + timedelta(days=at // 24)
        out.append(f"{d:%Y/%m/%d}/{at % 24:02d}")
        at += hours
    return out


def read_bytes(spark: SparkSession, paths: str | list[str], endings: str = "*") -> DataFrame:
    """Files as bytes: ``path, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", endings).load(paths).select("path", "length", "content")


def read_dataset(spark: SparkSession, path: str, schema: str, kind: str = "parquet", shard: int = 0, shards: int = 1, epochs: int = 1, max_records: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """The rows of this shard's files, once per epoch (column ``epoch``).

    Files are dealt to ``shards`` by their place in the order of names, so shards are disjoint and together whole.
    ``max_file_bytes`` leaves out larger files, ``max_records`` ends the scan early; both are the caller's wish.
    """
    if not 0 <= shard < shards:
        raise ValueError("a shard is one of 0 to shards - 1")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")  # names only
    own = [r for i, r in enumerate(sorted(listed.collect(), key=lambda r: r.path)) if i % shards == shard]
    files = [r.path for r in own if max_file_bytes is None or r.length <= max_file_bytes]
    rows = spark.read.schema(schema).format(kind).load(files) if files else spark.createDataFrame([], schema)
    every = repeated(rows, epochs)
    return every if max_records is None else every.limit(max_records)


def each_shard(rows: DataFrame, shards: int, key: str, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``work`` applied to each of ``shards`` shards of the rows in parallel; a key's rows lie in one shard."""
    return rows.repartition(shards, key).mapInPandas(work, schema)


def read_event_range(spark: SparkSession, root: str, start: date, end: date, prototypes: dict[str, str], shard: int = 0, shards: int = 1, max_events: int | None = None, max_errors: int | None = None, name: str = "event") -> DataFrame:
    """Events of the landing folders ``root/yyyy-MM-dd``, or ``root/day=yyyy-MM-dd``, from ``start`` to ``end``, both included: ``day, event, body, _corrupt``.

    A line goes to shard ``hash % shards``. ``prototypes`` maps an event's name to the schema of its body, the empty name
    to that of all others; without an empty name others are left out. ``body`` is the event read by its prototype, as
    JSON. Lines that don't parse keep their text in ``_corrupt``; more than ``max_errors`` of them raise
    :class:`DecodeBudget`. ``max_events`` ends the scan early.
    """
    days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
    lines = spark.read.text(root, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"/(?:\w+=)?(\d{4}-\d{2}-\d{2})/", 1).alias("day"), "value")
    own = lines.filter(F.col("day").isin([f"{d:%Y-%m-%d}" for d in days]) & (F.trim("value") != "") & (F.pmod(F.xxhash64("value"), F.lit(shards)) == shard))
    head = F.from_json("value", f"`{name}` string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = own.select("day", "value", head.alias("h")).select("day", "value", F.col(f"h.`{name}`").alias("event"), F.col("h._corrupt").alias("_corrupt"))
    if max_errors is not None and read.filter("_corrupt IS NOT NULL").limit(max_errors + 1).count() > max_errors:
        raise DecodeBudget(f"more than {max_errors} records don't decode")
    body = F.lit(None).cast("string") if "" not in prototypes else F.to_json(F.from_json("value", prototypes[""]))
    known = {n: s for n, s in prototypes.items() if n}
    for n, schema in known.items():
        body = F.when(F.col("event") == n, F.to_json(F.from_json("value", schema))).otherwise(body)
    kept = read if "" in prototypes else read.filter(F.col("_corrupt").isNotNull() | F.col("event").isin(*known))
    out = kept.select("day", "event", F.when(F.col("_corrupt").isNull(), body).alias("body"), "_corrupt")
    return out if max_events is None else out.limit(max_events)


def write_blocks(events: DataFrame, path: str, key: list[str], at: str, per_block: int) -> None:
    """Events in blocks of at most ``per_block`` per key, in order of ``at``: a row per block with its span and payload.

    The columns ``first, last, n`` are the block's metadata, by which a reader skips blocks; the payload is compressed.
    """
    others = [c for c in events.columns if c not in key]
    w = Window.partitionBy(*key).orderBy(at, *[c for c in others if c != at])
    numbered = events.withColumn("block", ((F.row_number().over(w) - 1) / per_block).cast("int"))
    blocks = numbered.groupBy(*key, "block").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(at, *[c for c in others if c != at]))).alias("events"))
    blocks.repartition(*key).sortWithinPartitions(*key, F.desc("block")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str, key: list[str], newest: int | None = None) -> DataFrame:
    """Events of all blocks, or of the ``newest`` few of each key, numbered from the newest (1) to the oldest: column ``nth``."""
    blocks = spark.read.parquet(path)
    w = Window.partitionBy(*key).orderBy(F.desc("block"))
    placed = blocks.withColumn("_before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_place", F.row_number().over(w))
    kept = placed if newest is None else placed.filter(F.col("_place") <= newest)
    return kept.select(*key, "_before", F.posexplode(F.reverse("events")).alias("_i", "_e")).select(*key, (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("nth"), "_e.*")


def build_index(rows: DataFrame, key: str, value: str, path: str, per_block: int = 10_000) -> None:
    """A key-value index: all values of a key in one row, in files sorted by key that hold a range of keys each."""
    entries = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(value)).alias("values"))
    entries.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("maxRecordsPerFile", per_block).parquet(path)


def merge_indexes(spark: SparkSession, paths: list[str], path: str, merge: Callable[[Column], Column], per_block: int = 10_000) -> None:
    """One index of several: ``merge`` makes a key's values of the array of its arrays; blocks are cut anew."""
    every = spark.read.parquet(*paths).groupBy("key").agg(F.collect_list("values").alias("v"))
    every.select("key", merge(F.col("v")).alias("values")).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("maxRecordsPerFile", per_block).parquet(path)


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """``key, values`` of each wanted key that the index has; files' key ranges let a scan skip others."""
    return spark.read.parquet(path).join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def repeated(rows: DataFrame, epochs: int) -> DataFrame:
    """The rows once per epoch, with the column ``epoch``; a table can't be repeated without end, so negative epochs raise."""
    if epochs < 0:
        raise ValueError("a batch can't repeat its rows without end")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))) if epochs > 0 else rows.withColumn("epoch", F.lit(0)).limit(0)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """The rows in a random order that a seed and their content fix: a range-partitioned sort of hashes."""
    return rows.withColumn("_o", F.xxhash64(F.lit(seed), *rows.columns)).orderBy("_o").drop("_o")
