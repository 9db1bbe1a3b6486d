"""Estimators chosen by name: forests and boosting over all line items, kernel ridge and partial least squares by supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import estimators, trees
from haplospark.plans.cis import _site_rows
from haplospark.plans.registry import query, table
from haplospark.plans.variants import r6

#: A line item's id is ten times its order's and its number; orders divisible by four are held out.
_HELD = "(id div 10) % 4 = 0"


def _items(spark, d):
    """Line items with five binned features, the price as target, a trait for each return flag."""
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = table(spark, d, "lineitem").join(sizes, "l_partkey")
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "p_size")])
    rows = rows.select(F.col("l_returnflag").alias("trait"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 1000).alias("y"), x.alias("x"))
    return trees.binned(rows.withColumn("train", ~F.expr(_HELD)), "x", 16).drop("x")


def _scored(found):
    held = found.where(_HELD).withColumnRenamed("y", "target")
    return estimators.scores(held).select("trait", "n", r6("pearson").alias("pearson"), r6("r2").alias("r2"))


@query("m2_forest", None)
def m2_forest(spark, d):
    """Held-out scores of a forest of eight trees by return flag."""
    return _scored(trees.forest(_items(spark, d), ["trait"], 8, 4, "id"))


@query("m2_boosting", None)
def m2_boosting(spark, d):
    """Held-out scores of six boosted trees by return flag."""
    return _scored(trees.boosted(_items(spark, d), ["trait"], 6, 3, 0.3, "id"))


@query("m2_estimators", None)
def m2_estimators(spark, d):
    """Held-out scores of kernel ridge and partial least squares on embeddings, for each supplier."""
    rows, vectors = _site_rows(spark, d)
    makers = {"kernel_ridge": lambda: estimators.KernelRidge(1.0), "pls": lambda: estimators.PartialLeastSquares(2)}
    found = estimators.fit_models(rows, {name: estimators.by_estimator(make) for name, make in makers.items()}, trait="site", features="emb", vectors=vectors)
    return estimators.scores(found, ["site", "model"]).select("site", "model", "n", r6("pearson").alias("pearson"), r6("r2").alias("r2"))
