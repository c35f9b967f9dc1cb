"""Scorers over feature columns as expressions: linear, radial, trees, logistic; ranks and set measures."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def scaled(features: list[str], offsets: list[float], scales: list[float]) -> list[Column]:
    """``(f + offset) * scale`` of each feature."""
    return [(F.col(f) + o) * s for f, o, s in zip(features, offsets, scales)]


def linear(features: list[Column], weights: list[float], bias: float = 0.0) -> Column:
    return sum((f * w for f, w in zip(features, weights)), F.lit(float(bias)))


def logistic(z: Column) -> Column:
    """``1 / (1 + e^-z)``."""
    return 1 / (1 + F.exp(-z))


def radial(features: list[Column], supports: list[tuple[list[float], float]], gamma: float) -> Column:
    """Sum of ``coefficient * exp(-gamma |x - support|^2)``; the supports are the model's, a fixed list."""
    def one(support: list[float], coefficient: float) -> Column:
        distance = sum(((f - s) ** 2 for f, s in zip(features, support)), F.lit(0.0))
        return F.exp(-gamma * distance) * coefficient

    return sum((one(s, c) for s, c in supports), F.lit(0.0))


def tree(features: list[Column], node: dict) -> Column:
    """A decision tree: ``{"value": v}`` or ``{"feature": i, "at": x, "below": node, "above": node}``; below is ``< at``."""
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(features[node["feature"]] < node["at"], tree(features, node["below"])).otherwise(tree(features, node["above"]))


def ensemble(features: list[Column], trees: list[dict]) -> Column:
    return sum((tree(features, t) for t in trees), F.lit(0.0))


def ranked(score: str, by: list[str], tie: str) -> Column:
    """Place within a group, best first, ties by ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))


def precision_recall(retrieved: Column, relevant: Column) -> Column:
    """``precision, recall, f1`` of two arrays as sets; all 0 when either is empty."""
    hit = F.size(F.array_intersect(retrieved, relevant)).cast("double")
    p, r = hit / F.size(F.array_distinct(retrieved)), hit / F.size(F.array_distinct(relevant))
    empty = (F.coalesce(F.size(retrieved), F.lit(0)) <= 0) | (F.coalesce(F.size(relevant), F.lit(0)) <= 0)
    zero = F.struct(F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"))
    return F.when(empty, zero).otherwise(F.struct(p.alias("precision"), r.alias("recall"), F.when(hit > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")))
