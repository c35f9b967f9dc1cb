"""Expectation maximisation of hidden types from the attributes used on values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def induce_types(samples: DataFrame, types: DataFrame, steps: int = 5, smoothing: float = 1e-3) -> tuple[DataFrame, DataFrame, list[float]]:
    """``(func, type, p)``, ``(type, attr, p)`` and the mean log loss before each step.

    ``samples`` are ``var, func, attrs`` (array), ``types`` are ``type, attr``. A type is possible for a variable if it has
    all attributes used on it. E: P(t | a, f) in proportion to P(t | f) times the product of P(a | t). M: both
    conditionals from expected counts with ``smoothing``. Every quantity is an aggregation over joins on (type, attribute)
    or (function, type); each step's tables are written to the shared folder, so the lineage doesn't grow.
    Variables without attributes or without a possible type are skipped.
    """
    uses = cut(samples.select("var", "func", F.array_distinct("attrs").alias("attrs")).filter("size(attrs) > 0"))
    long = uses.select("var", "func", F.explode("attrs").alias("attr"), F.size("attrs").alias("k"))
    possible = cut(long.join(types.distinct(), "attr").groupBy("var", "func", "k", "type").agg(F.count(F.lit(1)).alias("m")).filter("m = k").select("var", "func", "type"))
    own = types.distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n_attrs"))
    attr_p = cut(types.distinct().join(own, "type").select("type", "attr", (1.0 / F.col("n_attrs")).alias("pa")))
    start = possible.select("func", "type").distinct()
    func_p = cut(start.join(start.groupBy("func").agg(F.count(F.lit(1)).alias("n")), "func").select("func", "type", (1.0 / F.col("n")).alias("pf")))
    prior = uses.groupBy("func").agg(F.count(F.lit(1)).alias("n_f"))
    n = uses.count()
    losses: list[float] = []
    for _ in range(steps):
        lik = possible.join(long.select("var", "attr"), "var").join(attr_p, ["type", "attr"]).groupBy("var", "func", "type").agg(F.sum(F.log("pa")).alias("la"))
        joint = lik.join(func_p, ["func", "type"]).join(prior, "func").withColumn("j", F.exp("la") * F.col("pf") * F.col("n_f") / n)
        whole = joint.groupBy("var").agg(F.sum("j").alias("s"), F.count(F.lit(1)).alias("nt"))
        post = cut(joint.join(whole, "var").select("var", "func", "type", "s", ((F.col("j") + smoothing) / (F.col("s") + F.col("nt") * smoothing)).alias("p")))
        losses.append(post.groupBy("var").agg(F.first("s").alias("s")).agg(F.avg(-F.log("s"))).first()[0])
        counted = post.groupBy("func", "type").agg((F.sum("p") + smoothing).alias("c"))
        func_p = cut(counted.join(counted.groupBy("func").agg(F.sum("c").alias("t")), "func").select("func", "type", (F.col("c") / F.col("t")).alias("pf")))
        expected = post.join(long.select("var", "attr"), "var").groupBy("type", "attr").agg(F.sum("p").alias("c"))
        smooth = types.distinct().join(expected, ["type", "attr"], "left").select("type", "attr", (F.coalesce("c", F.lit(0.0)) + smoothing).alias("c"))
        attr_p = cut(smooth.join(smooth.groupBy("type").agg(F.sum("c").alias("t")), "type").select("type", "attr", (F.col("c") / F.col("t")).alias("pa")))
    return func_p.withColumnRenamed("pf", "p"), attr_p.withColumnRenamed("pa", "p"), losses
