"""Term weights and similarity over inverted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """``doc, term, c``."""
    return docs.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("c"))


def document_frequency(counts: DataFrame, doc: str) -> DataFrame:
    """``term, df``; ``counts`` has one row per document and term."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(counts: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """``term, df, idf`` with ``log10(N / df)``; an empty collection has weight 1 for all, an unseen term 0."""
    return document_frequency(counts, doc).withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")))


def probabilistic_idf(counts: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """``term, df, idf`` with ``ln((N - df) / df)``, only where that is above zero: terms of half the documents go."""
    df = document_frequency(counts, doc).filter(F.col("df") * 2 < n_docs)
    return df.withColumn("idf", F.log((F.lit(float(n_docs)) - F.col("df")) / F.col("df")))


def tf(counts: DataFrame, doc: str) -> DataFrame:
    """Adds ``tf``, the share of the document, and ``tf_short``, ``0.5 + 0.5 c / max c``."""
    w = Window.partitionBy(doc)
    return counts.withColumns({"tf": F.col("c") / F.sum("c").over(w), "tf_short": 0.5 + 0.5 * F.col("c") / F.max("c").over(w)})


def unit_vectors(weighted: DataFrame, doc: str, weight: str) -> DataFrame:
    """Adds ``norm``, the length of the document's vector."""
    return weighted.withColumn("norm", F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(doc))))


def similar(queries: DataFrame, vectors: DataFrame, doc: str, regular: float = 10.0) -> DataFrame:
    """Regularised cosine of each query with every document that shares a term: ``query, doc, score``.

    ``dot / ((|q| + regular) |d|)``. Both sides have ``doc, term, w, norm``; the join is on the term, and products are
    summed before and after the shuffle by pair. Terms that most documents hold are to be left out beforehand
    (:func:`probabilistic_idf` does), so a list is shorter than half the collection.
    """
    q = queries.select(F.col(doc).alias("query"), "term", F.col("w").alias("wq"), F.col("norm").alias("nq"))
    hits = vectors.join(q, "term").filter(F.col("query") != F.col(doc))
    return hits.groupBy("query", doc).agg((F.sum(F.col("w") * F.col("wq")) / ((F.first("nq") + regular) * F.first("norm"))).alias("score"))


def normalised(scores: DataFrame, group: list[str], score: str) -> DataFrame:
    """Adds ``softmax``, ``z`` (population deviation; 0 if that is 0) and ``part`` of the sum (0 if that is 0)."""
    w = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    dev, total = F.stddev_pop(score).over(w), F.sum(score).over(w)
    return scores.withColumn("_e", e).withColumns({"softmax": F.col("_e") / F.sum("_e").over(w), "z": F.when(dev > 0, (F.col(score) - F.avg(score).over(w)) / dev).otherwise(0.0), "part": F.when(total != 0, F.col(score) / total).otherwise(0.0)}).drop("_e")


def near_cursor(docs: DataFrame, doc: str, text: str, line: str, size: int) -> DataFrame:
    """Adds ``near``, the lines around a cursor line (from 1) with their emphasis: an array of ``(text, times)``.

    The cursor's line has ``size`` times, one k lines away ``size - k``, down to 1. Null where the line isn't in the text.
    """
    lines = F.split(F.col(text), "\n")
    inside = F.col(line).between(1, F.size(lines))
    weighted = F.transform(lines, lambda t, i: F.struct(t.alias("text"), (F.lit(size) - F.abs(i + 1 - F.col(line))).cast("int").alias("times")))
    return docs.withColumn("near", F.when(inside, F.filter(weighted, lambda w: w["times"] > 0)))


def mixed_vectors(whole: DataFrame, local: DataFrame, doc: str, part: float) -> DataFrame:
    """``doc, term, w, norm``: unit vectors of a text and of its neighbourhood of the cursor, mixed ``1 - part`` to ``part``.

    Both inputs have ``doc, term, w, norm``; a term of one side counts as zero on the other, vectors of length zero add
    nothing.
    """
    def scaled(v: DataFrame, by: float) -> DataFrame:
        return v.select(doc, "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm") * by).otherwise(0.0).alias("w"))

    mixed = scaled(whole, 1 - part).unionByName(scaled(local, part)).groupBy(doc, "term").agg(F.sum("w").alias("w"))
    return unit_vectors(mixed, doc, "w")
