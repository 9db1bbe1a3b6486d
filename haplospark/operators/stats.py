"""Grouped statistics whose variants are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_zscore(df: DataFrame, value: str, by: list[str], name: str = "z") -> DataFrame:
    """df with a z of ddof 0; a zero deviation counts as one; null with fewer than two values. Groups meet as one row each."""
    sd = F.coalesce(F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(1.0))
    stats = df.groupBy(*by).agg(F.avg(value).alias("m_"), sd.alias("sd_"), F.count(value).alias("n_"))
    z = F.when(F.col("n_") >= 2, (F.col(value) - F.col("m_")) / F.col("sd_"))
    return df.join(stats, by).withColumn(name, z).drop("m_", "sd_", "n_")


def with_train_zscore(df: DataFrame, value: str, train: Column, by: list[str], name: str = "z", guard: float = 1e-3) -> DataFrame:
    """df with a z by mean and ddof-1 deviation of the training rows only; null where the deviation is at most guard."""
    known = F.when(train, F.col(value))
    stats = df.groupBy(*by).agg(F.avg(known).alias("m_"), F.stddev_samp(known).alias("sd_"))
    z = F.when(F.col("sd_") > guard, (F.col(value) - F.col("m_")) / F.col("sd_"))
    return df.join(stats, by).withColumn(name, z).drop("m_", "sd_")


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties averaged."""
    ties = W.partitionBy(*by, value)
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def masked_metrics(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """n, pearson, r2, mse and mae over the rows where both are known; r and r2 null if undefined."""
    t, p = F.col(truth), F.col(pred)
    known = df.where(t.isNotNull() & p.isNotNull())
    sse = F.sum((t - p) * (t - p))
    sst = F.var_pop(t) * F.count(t)
    varied = (F.count(t) >= 2) & (F.var_pop(t) > 0)
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(varied & (F.var_pop(p) > 0), F.corr(t, p)).alias("pearson"),
        F.when(varied, 1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.avg((t - p) * (t - p)).alias("mse"),
        F.avg(F.abs(t - p)).alias("mae"),
    )
