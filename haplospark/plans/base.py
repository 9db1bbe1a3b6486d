"""Genomic stand-ins over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.operators.dealing import dealt
from haplospark.plans.registry import table

#: (chrom, pos): distinct sites.
SITES = "sites as (select distinct l_linenumber as chrom, l_partkey * 3 + l_partkey % 5 as pos from lineitem)"
#: (sample, variant, dosage 0-2).
DOSAGE = "dosage as (select l_suppkey as sample, l_partkey as variant, least(count(*), 2) as dosage from lineitem group by 1, 2)"
#: (accession, chrom, site, mc, total, context), one row each.
ALLC = """allc as (select l_suppkey as accession, l_linenumber as chrom, l_partkey as site, sum(cast(floor(l_quantity * l_discount * 10) as bigint)) as mc,
  sum(cast(l_quantity as bigint)) as total, min(l_returnflag) as context from lineitem group by 1, 2, 3)"""
#: (iid, grp, trait, value nullable).
PHENO = """pheno as (select c_custkey as iid, c_nationkey as grp, c_mktsegment as trait, case when c_custkey % 7 = 0 then null else c_acctbal end as value from customer)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("chrom"), (F.col("l_partkey") * 3 + F.col("l_partkey") % 5).alias("pos")).distinct()


def dosage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("variant")).agg(
        F.least(F.count(F.lit(1)), F.lit(2)).alias("dosage")
    )


def allc(spark: SparkSession, d: str, by: tuple[str, ...] = ("accession", "chrom", "site")) -> DataFrame:
    """Calls dealt out by some of their keys: nearly every row is a group, so aggregating before the shuffle saves nothing."""
    mc = F.floor(F.col("l_quantity") * F.col("l_discount") * 10)
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("accession"), F.col("l_linenumber").alias("chrom"), F.col("l_partkey").alias("site"),
        mc.cast("long").alias("mc"), F.col("l_quantity").cast("long").alias("total"), F.col("l_returnflag").alias("context"),
    )
    return dealt(rows, *by).groupBy("accession", "chrom", "site").agg(F.sum("mc").alias("mc"), F.sum("total").alias("total"), F.min("context").alias("context"))


def pheno(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("iid"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("trait"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("value"),
    )
