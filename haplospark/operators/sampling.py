"""Deterministic draws: order by md5 of id and seed, the same on every engine and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.ranking import row_numbers


def draw_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def split_ids(ids: DataFrame, id_col: str, seed: int, fractions: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """ids with a column part: the first fractions of the drawn order (rounded half to even), the rest is "train"."""
    ranked = row_numbers(ids, by or [], [draw_key(id_col, seed), id_col], "rn", "n")
    part, edge = F.lit("train"), 0.0
    bounds = []
    for name, f in fractions.items():
        edge += f
        bounds.append((name, edge))
    for name, e in reversed(bounds):
        part = F.when(F.col("rn") <= F.bround(F.col("n") * F.lit(e)), name).otherwise(part)
    return ranked.withColumn("part", part).drop("rn", "n")


def stratified(df: DataFrame, strata: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each stratum, in drawn order."""
    order = W.partitionBy(*strata).orderBy(draw_key(id_col, seed), id_col)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def numbered(ids: DataFrame, id_col: str, name: str = "ord") -> DataFrame:
    """Distinct ids with their number from 0 in order, counted within ranges, however sparse the ids are."""
    return row_numbers(ids.select(id_col).distinct(), [], [id_col], "rn_").select(id_col, (F.col("rn_") - 1).alias(name))
