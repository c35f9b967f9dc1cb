"""Search by pattern over an index of trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigram_postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``gram, doc``: the distinct runs of three characters of each text."""
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))
    return docs.filter(F.length(text) >= 3).select(F.explode(grams).alias("gram"), doc)


def search(docs: DataFrame, postings: DataFrame, doc: str, text: str, pattern: str, literal: str) -> DataFrame:
    """``doc, hits`` of the texts that ``pattern`` matches; each match holds ``literal``, of three characters or more.

    The documents that list every trigram of ``literal`` are the candidates, found by their posting lists alone; only
    their texts are then searched. A literal of fewer characters leaves all texts as candidates.
    """
    wanted = sorted({literal[i : i + 3] for i in range(len(literal) - 2)})
    found = docs
    if wanted:
        listed = postings.filter(F.col("gram").isin(wanted)).groupBy(doc).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        found = docs.join(listed, doc, "left_semi")
    return found.select(doc, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("hits")).filter("hits > 0")
