"""Feeds: sources, transforms and aggregators wired as a tree of lazy plans, with errors counted by reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A row is an error if this column, where it exists, isn't null.
ERROR = "_error"


@dataclass(eq=False)
class Feed:
    """A named step. ``make`` takes its parent's good rows and returns its own; a source takes the session."""

    name: str
    make: Callable
    kind: str = "transform"


def source(name: str, make: Callable[[SparkSession], DataFrame], only: tuple[str, list] | None = None) -> Feed:
    """Rows from a function of the session; ``only`` is a column and the keys let through."""
    if only is None:
        return Feed(name, make, "source")
    return Feed(name, lambda spark: make(spark).withColumn(ERROR, F.when(~F.col(only[0]).isin(only[1]), "filtered out")), "source")


def one_to_one(name: str, **columns: Column) -> Feed:
    """Each row with columns set; rows of which all of them are null are dropped."""
    return Feed(name, lambda df: df.withColumns(columns).filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()))


def flat_map(name: str, into: str, items: Column) -> Feed:
    """A row per element of an array; none for null and empty ones."""
    return Feed(name, lambda df: df.withColumn(into, F.explode(items)))


def pieces(name: str, work: Callable[[Iterator], Iterator], schema: str) -> Feed:
    """Any number of rows from each, made lazily: ``work`` takes and yields pandas frames, a batch at a time."""
    return Feed(name, lambda df: df.mapInPandas(work, schema))


def keep(name: str, condition: Column) -> Feed:
    return Feed(name, lambda df: df.filter(condition))


def check(name: str, reason: Column) -> Feed:
    """Rows with a non-null reason become errors: counted, not passed on."""
    return Feed(name, lambda df: df.withColumn(ERROR, reason))


def sum_of(name: str, by: list[str], **sums: Column) -> Feed:
    """An aggregator; sums are merged within and across partitions by Spark's partial aggregation."""
    return Feed(name, lambda df: df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "aggregator")


def written(name: str, write: Callable[[DataFrame], None]) -> Feed:
    """A sink for the side effect."""

    def run(df: DataFrame) -> DataFrame:
        write(df)
        return df

    return Feed(name, run, "aggregator")


@dataclass
class Pipeline:
    """A tree of feeds: each has one parent, a parent any number of dependents."""

    parents: dict[Feed, Feed | None] = field(default_factory=dict)

    def chain(self, *feeds: Feed) -> Pipeline:
        """Each feed depends on the one before; the first on what it has, or is a source."""
        for above, below in zip(feeds, feeds[1:]):
            self.parents.setdefault(above, None)
            self.parents[below] = above
        return self

    def fan_out(self, parent: Feed, *dependents: Feed) -> Pipeline:
        for d in dependents:
            self.chain(parent, d)
        return self

    def validate(self) -> None:
        names = [f.name for f in self.parents]
        if any(not n for n in names) or len(set(names)) != len(names):
            raise ValueError("names must be given and unique")
        for f, above in self.parents.items():
            if (above is None) != (f.kind == "source"):
                raise ValueError(f"{f.name}: a source has no parent, others have one")
            if above is not None and above.kind == "aggregator":
                raise ValueError(f"{above.name}: nothing follows an aggregator")

    def run(self, spark: SparkSession) -> Run:
        """Build all plans; nothing runs before a result is asked for, but for sinks."""
        self.validate()
        every: dict[Feed, DataFrame] = {}
        kept: list[DataFrame] = []

        def good(f: Feed) -> DataFrame:
            df = build(f)
            return df.filter(F.col(ERROR).isNull()).drop(ERROR) if ERROR in df.columns else df

        def build(f: Feed) -> DataFrame:
            if f not in every:
                made = f.make(spark) if self.parents[f] is None else f.make(good(self.parents[f]))
                shared = sum(above is f for above in self.parents.values()) > 1
                every[f] = made.persist(StorageLevel.MEMORY_AND_DISK) if shared else made  # computed once for all dependents
                if shared:
                    kept.append(every[f])
            return every[f]

        for f in self.parents:
            build(f)
        return Run({f.name: every[f] for f in every}, {f.name: good(f) for f in every}, kept)


@dataclass
class Run:
    """All rows of each feed, errors included, and the good ones."""

    rows: dict[str, DataFrame]
    good: dict[str, DataFrame]
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give up the rows that were kept for several dependents."""
        for df in self.kept:
            df.unpersist()

    def __getitem__(self, name: str) -> DataFrame:
        return self.good[name]

    def errors(self, name: str) -> DataFrame:
        """Errors of a feed by reason: ``reason, n``."""
        df = self.rows[name]
        if ERROR not in df.columns:
            df = df.withColumn(ERROR, F.lit(None).cast("string"))
        return df.filter(F.col(ERROR).isNotNull()).groupBy(F.col(ERROR).alias("reason")).agg(F.count(F.lit(1)).alias("n"))

    def error_sample(self, name: str, most: int = 10, seed: int = 1) -> DataFrame:
        """At most ``most`` errors of each reason, chosen by a hash: a sampling operator."""
        df = self.rows[name].filter(F.col(ERROR).isNotNull())
        h = F.xxhash64(F.lit(seed), *df.columns)
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(ERROR).orderBy(h))).filter(F.col("_n") <= most).drop("_n")
