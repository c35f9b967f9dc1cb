"""Daily deltas and incremental rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.aggregates import count_positive, ratio_true


def daily_delta(rows: DataFrame, key: str, day: str, sums: dict[str, Column], latest: dict[str, Column]) -> DataFrame:
    """One row per key and day: additive aggregates, and latest ones."""
    return rows.groupBy(key, day).agg(*[c.alias(n) for n, c in {**sums, **latest}.items()])


def advance_rollup(previous: DataFrame, delta: DataFrame, expired: DataFrame, key: str, sums: list[str], latest: list[str]) -> DataFrame:
    """The rollup of the next day: the previous one plus the day's delta less the delta that leaves the window.

    Sums add up, a missing part counts as zero; latest values are the delta's where it has one. Keys that drop to zero
    stay, with what was last known of them. The three inputs are united and aggregated once, so there is one shuffle,
    and nothing of the window between is read again.
    """
    def part(df: DataFrame, sign: int, age: int) -> DataFrame:
        newest = [F.col(c) if sign > 0 else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in latest]
        return df.select(key, F.lit(age).alias("_age"), *[(F.col(c) * sign).alias(c) for c in sums], *newest)

    rows = part(previous, 1, 0).unionByName(part(delta, 1, 1)).unionByName(part(expired, -1, -1))
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in latest])


def schema_rollup(rows: DataFrame, group: list[str], order: list[str], schema: dict[str, str]) -> DataFrame:
    """One row per ``group`` with aggregates generated from the columns' types.

    Texts give the newest value by ``order``, distinct values and their number; booleans any, all, how many and which
    share are true; numbers sum, least, most, mean and how many are above zero (null if never reported); maps sums by
    key, as a text in the keys' order. Names are those of the columns after ``__``. Maps are summed by (group, key) on
    their own, so a group's keys never gather before they are summed.
    """
    aggs, maps = [F.count(F.lit(1)).alias("n")], []
    for name, kind in schema.items():
        c, short = F.col(name), name.split("__", 1)[-1]
        if kind == "string":
            aggs += [F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"{short}__latest"), F.count_distinct(c).alias(f"{short}__different"), F.count(c).alias(f"{short}__n")]
        elif kind == "boolean":
            aggs += [F.bool_or(c).alias(f"{short}__any"), F.bool_and(c).alias(f"{short}__all"), F.count_if(c).alias(f"{short}__true"), F.round(ratio_true(c), 6).alias(f"{short}__part")]
        elif kind.startswith("map"):
            maps.append((name, short))
        else:
            d = c.cast("double")
            aggs += [F.round(F.sum(d), 4).alias(f"{short}__sum"), F.min(d).alias(f"{short}__min"), F.max(d).alias(f"{short}__max"), F.round(F.avg(d), 6).alias(f"{short}__mean"), count_positive(c).alias(f"{short}__positive")]
    out = rows.groupBy(*group).agg(*aggs)
    for name, short in maps:
        sums = rows.select(*group, F.explode(name).alias("_k", "_v")).groupBy(*group, "_k").agg(F.sum(F.col("_v").cast("bigint")).alias("_v"))
        texts = sums.groupBy(*group).agg(map_text(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v"))))).alias(f"{short}__by_key"))
        right = texts.select(*[F.col(g).alias(f"_{g}") for g in group], f"{short}__by_key")
        met = [out[g].eqNullSafe(right[f"_{g}"]) for g in group]
        on = met[0]
        for m in met[1:]:
            on = on & m
        out = out.join(right, on, "left").drop(*[f"_{g}" for g in group])
    return out


def map_text(m: Column) -> Column:
    """A map as ``key:value,...`` in the keys' order; null for an empty or null one."""
    entries = F.array_sort(F.map_entries(m))
    return F.when(F.size(m) > 0, F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], F.coalesce(e["value"].cast("string"), F.lit("")))), ","))


class WindowSums:
    """Sums by entity and kind over several trailing windows, brought from one day to the next by deltas alone."""

    def __init__(self, deltas: DataFrame, entity: str, day: str, kind: str, n: str, days: tuple[int, ...]) -> None:
        """``deltas`` has one row per entity, day and kind with its count ``n``."""
        self.deltas, self.entity, self.day, self.kind, self.n, self.days = deltas, entity, day, kind, n, days

    def at(self, day: Column) -> DataFrame:
        """``entity, kind, n_<days>d``: the windows that end with ``day``, summed from all their deltas."""
        inside = self.deltas.filter((F.col(self.day) <= day) & (F.col(self.day) > F.date_sub(day, max(self.days))))
        return inside.groupBy(self.entity, self.kind).agg(*[F.sum(F.when(F.col(self.day) > F.date_sub(day, d), F.col(self.n)).otherwise(0)).alias(f"n_{d}d") for d in self.days])

    def advance(self, before: DataFrame, day: Column) -> DataFrame:
        """The rollup of ``day`` from that of the day before: plus the day's delta, less the one that leaves each window.

        ``entity, total_<days>d, map_<days>d, most_28d``: sums, maps from kind to sum without zeros, and the kind with most in
        the second window. An entity of which nothing is left in the longest window goes.
        """
        keys = [self.entity, self.kind]
        new = self.deltas.filter(F.col(self.day) == day).select(*keys, F.col(self.n).alias("_new"))
        now = before.join(new, keys, "full_outer")
        for d in self.days:  # the lagged partitions
            gone = self.deltas.filter(F.col(self.day) == F.date_sub(day, d)).select(*keys, F.col(self.n).alias(f"_gone_{d}"))
            now = now.join(gone, keys, "left")
        zero = F.lit(0)
        sums = now.select(*keys, *[(F.coalesce(f"n_{d}d", zero) + F.coalesce("_new", zero) - F.coalesce(f"_gone_{d}", zero)).alias(f"n_{d}d") for d in self.days])
        longest, second = max(self.days), sorted(self.days)[min(1, len(self.days) - 1)]
        live = sums.filter(F.col(f"n_{longest}d") > 0)
        maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(f"n_{d}d") > 0, F.struct(self.kind, f"n_{d}d"))))).alias(f"map_{d}d") for d in self.days]
        most = F.max_by(self.kind, F.when(F.col(f"n_{second}d") > 0, F.struct(f"n_{second}d", self.kind))).alias(f"most_{second}d")
        return live.groupBy(self.entity).agg(*[F.sum(f"n_{d}d").alias(f"total_{d}d") for d in self.days], *maps, most)
