"""Sessions from merged intervals (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

GAP_MS = 1_800_000


def interval_cells(events: DataFrame, key: str, ms: str, gap_ms: int) -> DataFrame:
    """Merge the gap-length intervals of events into cells, before and after the shuffle.

    Two events of one key in the same ``gap_ms`` wide slot of time overlap by construction, so a slot's intervals
    always merge into one: ``(key, slot) -> first_ms, last_ms, n``. The merge is a minimum, a maximum and a sum, hence
    each input partition merges its own part first, and a key that holds a third of all rows leaves at most
    ``time span / gap`` rows, however many events it has.
    """
    slot = (F.col(ms) - F.pmod(F.col(ms), F.lit(gap_ms))).alias("_slot")
    return events.groupBy(F.col(key), slot).agg(F.min(ms).alias("_first"), F.max(ms).alias("_last"), F.count(F.lit(1)).alias("_n"))


def merge_cells(cells: DataFrame, key: str, gap_ms: int, *sums: str) -> DataFrame:
    """Merge overlapping cells of each key into sessions; adjacent cells overlap when at most ``gap_ms`` apart."""
    by_key = Window.partitionBy(key).orderBy("_slot")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(by_key) > gap_ms).cast("int"), F.lit(1))
    numbered = cells.withColumn("_open", opens).withColumn("_session", F.sum("_open").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_session").agg(F.min("_first").alias("start_ms"), F.max("_last").alias("end_ms"), *[F.sum(s).alias(s) for s in sums])


def sessions(events: DataFrame, key: str, ms: str, gap_ms: int = GAP_MS, message: str | Column | None = None) -> DataFrame:
    """One row per session of ``key``: ``start_ms, end_ms, duration_ms, events`` and, with ``message``, ``messages``.

    Every event opens an interval of ``gap_ms`` after it; intervals of one key that overlap merge. A session ends
    where the key's next event comes more than ``gap_ms`` later; an event exactly ``gap_ms`` later still belongs to it.

    Defined cases: rows whose key or time is null are skipped; equal times and repeated rows fall into one session and
    count in ``events`` as often as they occur; ``messages`` counts distinct non-null values of ``message`` once per
    session, even if the message was delivered with several times; an empty input gives no rows. Columns of the input
    other than those named are ignored, so their names may clash with the result's.

    This is the batch form, which also counts messages; :mod:`millrace.streaming.sessions` keeps the merged intervals
    as state under a watermark.
    """
    cols = [F.col(key).alias("_key"), F.col(ms).cast("bigint").alias("_ms")]
    if message is not None:
        cols.append((F.col(message) if isinstance(message, str) else message).alias("_message"))
    usable = events.select(*cols).filter("_key IS NOT NULL AND _ms IS NOT NULL")
    out = [F.col("_key").alias(key), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.col("_n").alias("events")]
    if message is None:
        return merge_cells(interval_cells(usable, "_key", "_ms", gap_ms), "_key", gap_ms, "_n").select(*out)

    # a message is counted in its first cell; the few that reach into further cells are settled by session below
    slot = (F.col("_ms") - F.pmod(F.col("_ms"), F.lit(gap_ms))).alias("_slot")
    spread = cut(usable.groupBy("_key", "_message", slot).agg(F.min("_ms").alias("_first"), F.max("_ms").alias("_last"), F.count(F.lit(1)).alias("_n")))  # read for the cells, twice, and for what repeats
    cells = spread.groupBy("_key", "_slot").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"), F.count("_message").alias("_messages"))
    merged = merge_cells(cells, "_key", gap_ms, "_n", "_messages")
    repeated = spread.filter("_message IS NOT NULL").groupBy("_key", "_message").agg(F.collect_set("_slot").alias("_slots"), F.min("_first").alias("_from")).filter(F.size("_slots") > 1)
    # each further slot of a message that lies in the session of an earlier slot was counted twice
    pairs = repeated.select("_key", "_message", F.explode("_slots").alias("_slot"))
    placed = pairs.join(_slot_sessions(cells, gap_ms), ["_key", "_slot"]).groupBy("_key", "_session").agg((F.count(F.lit(1)) - F.count_distinct("_message")).alias("_twice"))
    counted = merged.join(placed, ["_key", "_session"], "left")
    return counted.select(*out, (F.col("_messages") - F.coalesce("_twice", F.lit(0))).alias("messages"))


def _slot_sessions(cells: DataFrame, gap_ms: int) -> DataFrame:
    by_key = Window.partitionBy("_key").orderBy("_slot")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(by_key) > gap_ms).cast("int"), F.lit(1))
    return cells.withColumn("_open", opens).select("_key", "_slot", F.sum("_open").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_session"))
