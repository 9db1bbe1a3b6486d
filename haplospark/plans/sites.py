"""Flagship: coding cost of held-out calls under a smoothed per-site marginal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.plans.registry import query, table

ALPHA, TRAIN_OF_16 = 0.5, 12

FLAGSHIP_SQL = """
with calls as (
  select l_partkey as site, l_suppkey as sample, max(case when l_returnflag = 'R' then 1 else 0 end) as alt
  from lineitem group by 1, 2),
parts as (
  select *, strpos('0123456789abcdef', substr(md5(concat(cast(sample as varchar), '-7')), 1, 1)) <= 12 as train from calls),
marginal as (
  select site, (sum(alt) + 0.5) / (count(*) + 1.0) as p from parts where train group by 1),
scored as (
  select c.site, c.alt, coalesce(m.p, 0.5) as p from parts c left join marginal m using (site) where not c.train)
select site, count(*) as n_calls, sum(alt) as n_alt,
  round(avg(-log2(case when alt = 1 then p else 1 - p end)), 6) as bits
from scored group by 1
"""


@query("flagship_site_bits", FLAGSHIP_SQL)
def flagship_site_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"))
        .agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("alt"))
    )
    digit = F.substring(F.md5(F.concat(F.col("sample").cast("string"), F.lit("-7"))), 1, 1)
    calls = calls.withColumn("train", F.instr(F.lit("0123456789abcdef"), digit) <= TRAIN_OF_16)
    marginal = (
        calls.where("train")
        .groupBy("site")
        .agg(((F.sum("alt") + ALPHA) / (F.count(F.lit(1)) + 2 * ALPHA)).alias("p"))
    )
    p = F.coalesce(F.col("p"), F.lit(0.5))
    cost = -F.log2(F.when(F.col("alt") == 1, p).otherwise(1 - p))
    return (
        calls.where(~F.col("train"))
        .join(marginal, "site", "left")
        .groupBy("site")
        .agg(
            F.count(F.lit(1)).alias("n_calls"),
            F.sum("alt").alias("n_alt"),
            F.round(F.avg(cost), 6).alias("bits"),
        )
    )
