"""Structured Streaming forms: mergeable accumulators and event windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of site_accumulators that add up.
SUMS = ("n_obs", "sum_p", "sum_p2", "sum_noise", "sum_m", "sum_total", "n_seen")
_LEDGER = "batch string, source string"


def site_accumulators(calls: DataFrame, min_cov: int = 2, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """Sums of calls(site, mc, total), per site or by more; works on batch and stream alike, as every column is a mergeable sum."""
    p = F.col("mc") / F.col("total")
    deep = F.col("total") >= min_cov
    return calls.groupBy(*by).agg(
        F.count(F.when(deep, 1)).alias("n_obs"),
        F.sum(F.when(deep, p)).alias("sum_p"),
        F.sum(F.when(deep, p * p)).alias("sum_p2"),
        F.sum(F.when(deep, p * (1 - p) / F.greatest(F.col("total") - 1, F.lit(1)))).alias("sum_noise"),
        F.sum("mc").alias("sum_m"), F.sum("total").alias("sum_total"), F.count(F.lit(1)).alias("n_seen"),
    )


def event_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and sum of events(ts, event_type, value) by tumbling window, with a watermark; ts must be a timestamp with zone."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def merge_accumulators(partials: DataFrame) -> DataFrame:
    """The sums of partial site accumulators, by site."""
    return partials.groupBy("site").agg(*[F.sum(c).alias(c) for c in SUMS])


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_LEDGER).json(f"{folder}/ledger") if there else spark.createDataFrame([], _LEDGER)


def accumulate_sources(sources: DataFrame, read: Callable[[list[str]], DataFrame], folder: str, batch: int = 64, min_cov: int = 2) -> int:
    """Keep the site accumulators of each of sources(source) in folder; the number of sources that were new.

    read gives calls(site, mc, total) of a list of sources. Sources are taken batch at a time:
    their sums are written as one table, named after them, and then entered in the ledger.
    What a run that broke off left without an entry is written anew or never read, so a
    source counts once however often this is called.
    """
    spark = sources.sparkSession
    waiting = sorted(r[0] for r in sources.distinct().join(_ledger(spark, folder), "source", "left_anti").collect())  # names of files
    for at in range(0, len(waiting), batch):
        names = waiting[at : at + batch]
        key = hashlib.md5("\n".join(names).encode()).hexdigest()
        site_accumulators(read(names), min_cov).write.mode("overwrite").parquet(f"{folder}/batches/batch={key}")
        spark.createDataFrame([(key, n) for n in names], _LEDGER).coalesce(1).write.mode("append").json(f"{folder}/ledger")
    return len(waiting)


def accumulated(spark: SparkSession, folder: str) -> DataFrame:
    """The site accumulators of all sources in the folder's ledger."""
    known = _ledger(spark, folder).select("batch").distinct()
    return merge_accumulators(spark.read.parquet(f"{folder}/batches").join(known, "batch", "left_semi"))
