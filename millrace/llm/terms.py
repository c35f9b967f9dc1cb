"""Frequencies of all terms and n-grams by suffix sorting (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import HotKeys
from millrace.session import cut

#: Suffixes with one first term beyond this many go to several tasks, by their records.
TASK_ROWS = 200_000

SEPARATOR = "\x00"
_OUT = "terms array<string>, total bigint, records bigint"


def _joined(terms: Column) -> Column:
    """The terms as one text that sorts as they do: SEPARATOR, below all characters, between them, and escaped within."""
    safe = F.transform(terms, lambda t: F.replace(F.replace(t, F.lit("\x01"), F.lit("\x01\x02")), F.lit(SEPARATOR), F.lit("\x01\x01")))
    return F.array_join(F.when(F.exists(terms, lambda t: t.rlike("[\x00\x01]")), safe).otherwise(terms), SEPARATOR)


def _taken_apart(terms: list[str]) -> list[str]:
    return [t.replace("\x01\x01", SEPARATOR).replace("\x01\x02", "\x01") if "\x01" in t else t for t in terms]


def count_prefixes(rows: Iterator[tuple[str, object, int]]) -> Iterator[tuple[list[str], int, int]]:
    """Counts of all prefixes of joined suffixes that come in reverse lexicographic order: ``(prefix, total, records)``.

    A stack holds the terms of the current suffix; beside each lie the count and the record set of the prefix that
    ends there. Once a suffix comes that shares fewer terms, the deeper prefixes can't come again: they are popped and
    emitted, and what they counted is added to the prefix below. Record sets are dropped as they are emitted.
    """
    terms: list[str] = []
    totals: list[int] = []
    records: list[set] = []

    def pop() -> tuple[list[str], int, int]:
        done = (_taken_apart(terms), totals[-1], len(records[-1]))
        terms.pop()
        total, own = totals.pop(), records.pop()
        if totals:
            totals[-1] += total
            if len(own) > len(records[-1]):
                own, records[-1] = records[-1], own
            records[-1] |= own
        return done

    for joined, run in groupby(rows, key=lambda r: r[0]):
        suffix = joined.split(SEPARATOR)
        shared = 0
        while shared < min(len(suffix), len(terms)) and suffix[shared] == terms[shared]:
            shared += 1
        while len(terms) > shared:
            yield pop()
        for t in suffix[shared:]:
            terms.append(t)
            totals.append(0)
            records.append(set())
        for _, record, n in run:
            totals[-1] += n
            if record is not None:
                records[-1].add(record)
    while terms:
        yield pop()


def term_frequencies(suffixes: DataFrame, suffix: str, record: str, n: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``terms, total, records`` of every prefix of the given suffixes.

    ``suffixes`` has one row per truncated suffix (an array of terms), record and count of it there. Rows go to the
    task of the suffix's first term. First terms of more than ``task_rows`` rows (:class:`HotKeys`) are split before that
    shuffle, by a hash of the record: each task then sees whole records, so the counts of records add up as those of
    occurrences do, and a last sum over the tasks' results, not over rows, is exact. Rows without a record are spread
    by suffix and input partition.

    Defined cases: null or empty suffixes are skipped, as are null terms' rows; a null record counts in ``total`` but
    not in ``records``; repeated rows add up; an empty input gives no rows.
    """
    rows = suffixes.select(F.col(suffix).alias("_s"), F.col(record).alias("_r"), F.col(n).cast("bigint").alias("_n")).filter("size(_s) > 0 AND NOT exists(_s, x -> x IS NULL)")
    rows = rows.withColumn("_s", _joined(F.col("_s")))
    first = F.substring_index("_s", SEPARATOR, 1)
    hot = HotKeys(rows, first, task_rows)
    # equal suffixes without a record of one input partition may go anywhere: they have no record to keep whole
    by = F.when(F.col("_r").isNull(), F.xxhash64("_s", F.spark_partition_id())).otherwise(F.xxhash64("_r"))
    routed = hot.salted(rows, by).withColumn("_f", first)
    ordered = routed.select("_f", "_salt", "_s", "_r", "_n").repartition("_f", "_salt").sortWithinPartitions("_f", "_salt", F.desc("_s"))

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(zip(b.column("_f").to_pylist(), b.column("_salt").to_pylist()), b.column("_s").to_pylist(), b.column("_r").to_pylist(), b.column("_n").to_pylist())

        held: list[tuple] = []
        for _, part in groupby(stream(), key=lambda r: r[0]):
            for found in count_prefixes(r[1:] for r in part):
                held.append(found)
                if len(held) >= 10_000:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    parts = ordered.mapInArrow(stack, _OUT)
    if not hot.any:  # all suffixes of a first term met in one task
        return parts
    return parts.groupBy("terms").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.string()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["terms", "total", "records"])


def value_frequencies(rows: DataFrame, value: str, record: str, rare_below: int = 3, common_above: float = 0.05, task_rows: int = TASK_ROWS) -> DataFrame:
    """``value, rows, records, mark`` of every distinct non-empty value: suffixes of one term each.

    ``mark`` is ``rare`` below ``rare_below`` distinct records, ``common`` above the share ``common_above`` of all distinct
    non-null records of ``rows`` (those of rows without a value included), else ``useful``. A value that would be
    both is ``rare``. Rows of one value and record are added up before they are routed.
    """
    pairs = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.array(F.col(value)).alias("s"), F.col(record).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    counted = term_frequencies(cut(pairs), "s", "r", "n", task_rows)  # read twice: to find hot values and to route
    everyone = rows.select(record).filter(F.col(record).isNotNull()).distinct().count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * everyone, "common").otherwise("useful")
    return counted.select(F.col("terms")[0].alias(value), F.col("total").alias("rows"), "records", mark.alias("mark"))


def text_suffixes(texts: DataFrame, record: str, text: str, longest: int) -> DataFrame:
    """The truncated suffixes of texts, ``s, r, n``: from each word on, up to ``longest`` words.

    Words are runs of letters, digits and underscores in lower case; whole texts are read.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    split = texts.select(F.col(record).alias("r"), words.alias("w")).filter("size(w) > 0")
    # shifted copies side by side, short ones padded with nulls: linear in the words of a text
    shifted = F.arrays_zip(F.col("w").alias("t0"), *[F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"t{i}") for i in range(1, longest)])
    each = split.select(F.explode(shifted).alias("z"), "r")
    return each.select(F.array_compact(F.array(*[F.col(f"z.t{i}") for i in range(longest)])).alias("s"), "r", F.lit(1).cast("bigint").alias("n"))


def ngram_frequencies(texts: DataFrame, record: str, text: str, longest: int = 2, least: int = 1, rare_below: int = 3, common_above: float = 0.05, task_rows: int = TASK_ROWS) -> DataFrame:
    """``ngram, n, rows, records, mark`` of every n-gram of up to ``longest`` words that occurs at least ``least`` times.

    Marks are as in :func:`value_frequencies`, against all texts with a record id. Null and blank texts have no
    n-grams. Texts without a record id count in ``rows`` only.
    """
    counted = term_frequencies(text_suffixes(texts, record, text, longest), "s", "r", "n", task_rows).filter(F.col("total") >= least)
    everyone = texts.select(record).filter(F.col(record).isNotNull()).distinct().count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * everyone, "common").otherwise("useful")
    return counted.select(F.concat_ws(" ", "terms").alias("ngram"), F.size("terms").alias("n"), F.col("total").alias("rows"), "records", mark.alias("mark"))
