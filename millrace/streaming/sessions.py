"""The session operator on a stream: merged interval state per key, a watermark and late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sessions import GAP_MS
from millrace.streaming.features import state_store

#: Times further than this many ms from 1970 are none: a stream's instants must leave room for the watermark beyond them.
#: A stream's watermark starts at 1970, so a table's times enter moved by this much, lest those before 1970 be late.
LIMIT_MS = 1_000_000_000_000_000
#: How far the watermark stays behind where no event may count as late: more than two times can lie apart.
NEVER_LATE = f"{2 * LIMIT_MS // 86_400_000 + 1_000_000} days"
#: The moved time of the row that ends a table: NEVER_LATE behind it still lies beyond all other times.
END_MS = 6 * LIMIT_MS


def merge_intervals(held: list[tuple[int, int, int]], new: list[tuple[int, int, int]], gap_ms: int) -> list[tuple[int, int, int]]:
    """Merge ``(first, last, n)`` intervals that lie at most ``gap_ms`` apart; a late one may join two that were apart.

    What the state does, in Python, for tests.
    """
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(held + new):
        if out and first - out[-1][1] <= gap_ms:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def session_stream(events: DataFrame, key: str, at: str, gap_ms: int = GAP_MS, lateness: str = "1 hour") -> DataFrame:
    """Closed sessions ``key, start_ms, end_ms, events`` of a stream whose column ``at`` is a timestamp.

    Every event opens an interval of ``gap_ms``; the state of a key is the intervals that the watermark (``lateness``
    behind the newest event) has not closed, and overlapping ones merge. An event that is late but not behind the
    watermark opens, widens or joins intervals as if it had come in time. A session is emitted once, when the watermark
    has passed its end; rows without key or time are skipped, and times before 1970 are late. The state is Spark's own (``session_window``), inside the
    JVM. Started under :func:`millrace.streaming.features.state_store`, each input partition merges its intervals
    before the shuffle, so a hot key sends its partition's sessions, not its events.
    """
    usable = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", lateness)
    ms = F.unix_millis("at")
    merged = usable.groupBy("k", F.session_window("at", f"{gap_ms} milliseconds").alias("w")).agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.count(F.lit(1)).alias("events"))
    return merged.select(F.col("k").alias(key), "start_ms", "end_ms", "events")


def run_sessions(stream: DataFrame, at: str, key: str, ms: str, gap_ms: int = GAP_MS, lateness: str = NEVER_LATE, end: bool = True) -> DataFrame:
    """Run what the stream holds now through :func:`session_stream`: ``key, start_ms, end_ms, events``.

    ``at`` is a folder all executors share, with the checkpoint (state, offsets) and the emitted sessions; a later call
    with the same ``at`` goes on where this one ended. With ``end`` the stream is over: a last row with a time beyond all
    others moves the watermark past every interval, which closes them. By default no event is ever too late, however a
    table's files are ordered, and the state holds all sessions until the end; with a finite ``lateness`` it holds the
    open ones, and events behind the watermark are dropped.

    Defined cases: rows without key or time, or with a time more than LIMIT_MS from 1970, are skipped; repeated rows
    count in ``events``; an event exactly ``gap_ms`` after the one before belongs to its session; an empty stream has
    no sessions.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    ends = f"k {kind}, ms bigint"

    def write_end(rows: list[tuple]) -> None:
        spark.createDataFrame(rows, ends).coalesce(1).write.mode("append").parquet(f"{at}/end")

    events = stream.select(F.col(key).alias("k"), F.col(ms).cast("bigint").alias("ms")).filter(F.col("ms").between(-LIMIT_MS, LIMIT_MS)).withColumn("ms", F.col("ms") + LIMIT_MS)

    def run() -> None:
        both = events.unionByName(spark.readStream.schema(ends).parquet(f"{at}/end")).filter("ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms"))
        # the row that ends the stream has no key of its own: any value does, as its interval is never closed
        keyed = both.withColumn("k", F.when(F.col("ms") == END_MS, F.coalesce("k", F.lit(0).cast(kind))).otherwise(F.col("k")))
        out = session_stream(keyed, "k", "at", gap_ms, lateness)
        out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").format("parquet").option("path", f"{at}/sessions").trigger(availableNow=True).start().awaitTermination()

    with state_store(spark):
        write_end([])
        run()
        if end:
            write_end([(None, END_MS)])
            run()
    found = spark.read.schema(f"k {kind}, start_ms bigint, end_ms bigint, events bigint").parquet(f"{at}/sessions")
    return found.select(F.col("k").alias(key), (F.col("start_ms") - LIMIT_MS).alias("start_ms"), (F.col("end_ms") - LIMIT_MS).alias("end_ms"), "events")
