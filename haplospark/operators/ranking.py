"""Numbers and ranks in order, without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.stored import stored


def row_numbers(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rn", total: str | None = None) -> DataFrame:
    """df with a row's number from 1 within its group by, in order, and the group's size as total.

    Rows are cut into ranges of (by, order), which split a large group; a range is numbered
    in its task, after the rows of the ranges before it, which are summed up a row a range.
    order should tell all rows apart, or equal ones are numbered in any order. A null in by
    is a group of its own.
    """
    keys = [f"o{k}_" for k in range(len(order))]
    keyed = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys)])
    ranged = stored(keyed.repartitionByRange(*by, *keys).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_", *by).agg(F.count(F.lit(1)).alias("n_"))
    group = W.partitionBy(*by)  # a row a range
    below = F.sum("n_").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(
        F.col("part_").alias("p_"), *[F.col(c).alias(f"b{k}_") for k, c in enumerate(by)], F.coalesce(below, F.lit(0)).alias("start_"), F.sum("n_").over(group).alias("total_")
    )
    within = F.row_number().over(W.partitionBy("part_", *by).orderBy(*keys))
    same = F.col("part_") == F.col("p_")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"b{k}_"))
    sums = [(F.col("start_") + F.col("within_")).cast("long").alias(name)]
    if total:
        sums.append(F.col("total_").alias(total))
    return ranged.withColumn("within_", within).join(starts, same).select(*df.columns, *sums)


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """df with ranks from 1 within its group, ties averaged; by and value have no nulls."""
    numbered = row_numbers(df, by, [value], "rn_")
    ties = numbered.groupBy(*by, value).agg(F.avg("rn_").alias(name))
    return numbered.drop("rn_").join(ties, [*by, value]).select(*df.columns, name)


def counted_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """As average_ranks, from a row for each value and its count; nulls are equal and come last, in by as in value."""
    order = F.col(value).asc_nulls_last()
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"))
    ranged = stored(counts.repartitionByRange(*by, order).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_", *by).agg(F.sum("n_").alias("all_"))
    below = F.sum("all_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    starts = sizes.select(F.col("part_").alias("p_"), *[F.col(c).alias(f"c{k}_") for k, c in enumerate(by)], F.coalesce(below, F.lit(0)).alias("start_"))
    before = F.sum("n_").over(W.partitionBy("part_", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    keys = [F.col(c).alias(f"b{k}_") for k, c in enumerate(by)]
    ranks = ranged.select(*keys, F.col(value).alias("v_"), "n_", "part_", F.coalesce(before, F.lit(0)).alias("before_"))
    same, match = F.col("part_") == F.col("p_"), F.col(value).eqNullSafe(F.col("v_"))
    for k, c in enumerate(by):
        same = same & F.col(f"b{k}_").eqNullSafe(F.col(f"c{k}_"))
        match = match & F.col(c).eqNullSafe(F.col(f"b{k}_"))
    rank = F.col("start_") + F.col("before_") + (F.col("n_") + 1) / 2
    return df.join(ranks.join(starts, same).select(*[f"b{k}_" for k in range(len(by))], "v_", rank.alias(name)), match).select(*df.columns, name)
