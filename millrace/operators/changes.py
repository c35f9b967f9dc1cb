"""Ordered replay of a change feed (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.skew import HotKeys
from millrace.session import cut

#: A key with more changes than this is replayed in several runs whose outcomes are replayed once more.
RUN_ROWS = 50_000


class Replay:
    """State machine of one key: absent or present, with the order of the last change and of each column's last value."""

    __slots__ = ("cleared", "last", "op", "seen", "values")

    def __init__(self) -> None:
        self.last: tuple = ()
        self.cleared: tuple = ()
        self.op = ""
        self.seen: tuple = ()
        self.values: dict[str, tuple[tuple, object]] = {}

    def apply(self, order: tuple, op: str, columns: dict[str, object]) -> None:
        """Apply a change unless its order is not beyond the last applied one."""
        if order <= self.last:
            return
        self.last, self.op = order, op
        if op == "d":
            self.cleared, self.values = order, {}
            return
        for name, value in columns.items():
            self.values[name] = (order, value)

    def absorb(self, last: tuple, op: str, cleared: tuple, values: dict[str, tuple[tuple, object]]) -> None:
        """Join the outcome of another run of the same key; the runs may interleave in order."""
        if cleared > self.cleared:
            self.cleared = cleared
            self.values = {c: v for c, v in self.values.items() if v[0] > cleared}
        for name, held in values.items():
            if held[0] > self.cleared and held[0] > self.values.get(name, ((),))[0]:
                self.values[name] = held
        if last > self.last:
            self.last, self.op = last, op


def replay_changes(changes: DataFrame, key: str, at: str, seq: str, op: str, columns: list[str], partial: bool = True, run_rows: int = RUN_ROWS, tombstones: bool = False) -> DataFrame:
    """The rows that exist after all changes: ``key, at, seq`` of the last change and ``columns``.

    ``op`` is ``i``, ``u`` or ``d``. Changes of a key take effect in order of ``(at, seq)``; one that is delivered
    again has the same order and is skipped. An update of an absent row creates it, a delete of an absent row does
    nothing, an insert of a present row updates it. With ``partial``, a null column of a change leaves the value as it
    was; without, each insert and update carries the whole row and nulls are values.

    ``tombstones`` adds the deleted rows and a column ``op``, for :func:`apply_to`.

    Work: changes are dealt by key, sorted by order inside each partition and replayed one after the other, with one
    key's state in memory at a time. A key with more than ``run_rows`` changes is dealt to several runs by a hash of its
    order; a run's outcome holds the order of each value, so outcomes join exactly, whichever run a change fell into.

    Defined cases: changes with a null key, time or sequence, or another ``op``, are skipped; equal orders are one
    change, of which the one with the smallest column text counts; an empty input gives no rows; other input columns
    are ignored.
    """
    spark = changes.sparkSession
    kinds = {c: changes.schema[c].dataType for c in columns}
    usable = changes.select(F.col(key).alias("_k"), F.col(at).cast("bigint").alias("_t"), F.col(seq).cast("bigint").alias("_s"), F.col(op).alias("_op"), *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(columns)])
    usable = usable.filter("_k IS NOT NULL AND _t IS NOT NULL AND _s IS NOT NULL AND _op IN ('i', 'u', 'd')")
    payload = F.struct(*[F.col(f"_c_{i}") for i in range(len(columns))]) if columns else F.struct(F.lit(None).cast("string"))

    hot = HotKeys(usable, F.col("_k"), run_rows)
    dealt = hot.salted(usable.withColumn("_p", F.to_json(payload)), F.xxhash64("_t", "_s"), "_run")

    outcome = T.StructType(
        [T.StructField("_k", changes.schema[key].dataType), T.StructField("_t", T.LongType()), T.StructField("_s", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_ct", T.LongType()), T.StructField("_cs", T.LongType())]
        + [T.StructField(f"_v_{i}", T.StructType([T.StructField("t", T.LongType()), T.StructField("s", T.LongType()), T.StructField("v", kinds[c])])) for i, c in enumerate(columns)]
    )
    arrow_kind = _arrow_schema(spark, outcome)
    names = [f"_c_{i}" for i in range(len(columns))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, state = None, Replay()
            for b in batches:
                cols = {n: b.column(n).to_pylist() for n in ("_k", "_run", "_t", "_s", "_op", *names)}
                for i, who in enumerate(zip(cols["_k"], cols["_run"])):
                    if who != held:
                        if held is not None:
                            yield held[0], state
                        held, state = who, Replay()
                    kind = cols["_op"][i]
                    state.apply((cols["_t"][i], cols["_s"][i]), kind, {} if kind == "d" else {n: cols[n][i] for n in names if not (partial and cols[n][i] is None)})
            if held is not None:
                yield held[0], state

        yield from _emit(rows(), arrow_kind, len(columns))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, state = None, Replay()
            for b in batches:
                for r in b.to_pylist():
                    if r["_k"] != held:
                        if held is not None:
                            yield held, state
                        held, state = r["_k"], Replay()
                    values = {n: ((v["t"], v["s"]), v["v"]) for i, n in enumerate(names) if (v := r[f"_v_{i}"])}
                    state.absorb((r["_t"], r["_s"]), r["_op"], () if r["_ct"] is None else (r["_ct"], r["_cs"]), values)
            if held is not None:
                yield held, state

        yield from _emit(rows(), arrow_kind, len(columns))

    ordered = dealt.repartition("_k", "_run").sortWithinPartitions("_k", "_run", "_t", "_s", "_p").drop("_p")
    runs = ordered.mapInArrow(first, outcome)
    whole = runs
    if hot.any:  # only the outcomes of split keys meet again
        cold, split = hot.parted(cut(runs))
        whole = cold.unionByName(split.repartition("_k").sortWithinPartitions("_k").mapInArrow(second, outcome))
    alive = whole if tombstones else whole.filter("_op <> 'd'")
    extra = [F.col("_op").alias("op")] if tombstones else []
    return alive.select(F.col("_k").alias(key), F.col("_t").alias(at), F.col("_s").alias(seq), *extra, *[F.col(f"_v_{i}.v").alias(c) for i, c in enumerate(columns)])


def apply_to(current: DataFrame, changes: DataFrame, key: str, at: str, seq: str, op: str, columns: list[str], **options) -> DataFrame:
    """The table ``current`` (a result of :func:`replay_changes` with ``tombstones``) after further changes.

    Rows of ``current`` enter as changes at the order of their last change, so changes that were applied before are
    skipped and late ones take no effect on newer values. For whole-row changes (``partial=False``); partial changes
    that come later than a newer change of another column need the whole feed.
    """
    held = current.select(key, at, seq, F.when(F.col("op") == "d", "d").otherwise("i").alias(op), *columns)
    feed = changes.select(key, F.col(at).cast("bigint").alias(at), F.col(seq).cast("bigint").alias(seq), op, *columns)
    return replay_changes(held.unionByName(feed), key, at, seq, op, columns, tombstones=True, **({"partial": False} | options))


def _arrow_schema(spark, schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _emit(rows: Iterator[tuple], schema: pa.Schema, n_columns: int, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for who, state in rows:
        out = {"_k": who, "_t": state.last[0], "_s": state.last[1], "_op": state.op, "_ct": state.cleared[0] if state.cleared else None, "_cs": state.cleared[1] if state.cleared else None}
        for i in range(n_columns):
            v = state.values.get(f"_c_{i}")
            out[f"_v_{i}"] = None if v is None else {"t": v[0][0], "s": v[0][1], "v": v[1]}
        held.append(out)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
