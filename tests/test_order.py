"""Sums and first rows are those of the rows as the files have them."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from haplospark.plans import registry


def test_means_add_rows_in_file_order(spark, tmp_path):
    values = [0.0, 0.01, 0.02, 0.05, 0.07, 0.09, 0.1, 0.14, 0.18]
    for a, b, c, d in itertools.product(values, repeat=4):  # rows whose halves add up to another side of the cut
        if (((a + b) + c + d) / 4 <= 0.09) != (((a + b) + (c + d)) / 4 <= 0.09):
            break
    else:
        pytest.fail("no such rows")
    for n, half in enumerate(((a, b), (c, d))):
        rows = spark.createDataFrame([(1, 5, x) for x in half], "l_suppkey long, l_partkey long, l_discount double")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{n}")
        part = next((tmp_path / str(n)).glob("*.parquet"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"{n}.parquet")
    spark.createDataFrame([(1,), (5,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = registry.queries()["j27_max_kinship"](spark, str(tmp_path)).select(F.col("kept")).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == (((a + b) + c + d) / 4 <= 0.09)


def test_first_of_equal_calls_is_that_of_the_files(spark, tmp_path):
    ties = [(s, 4, 2, "ANR"[(s + k) % 3]) for k in range(40) for s in range(30)]
    odd = [(99, 1, 1, None), (99, 3, 1, "R"), (99, None, 1, "A"), (98, 1, 1, None), (97, None, 1, "N")]
    folder = tmp_path / "lineitem.parquet"
    spark.createDataFrame(ties + odd, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.option("parquet.block.size", "2000").parquet(str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = {r.site: (r.context, r.changed) for r in registry.queries()["a3_first_context"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view lineitem as select * from '{folder}/*.parquet'")
    assert got == {s: (c, x) for s, c, x in duck.execute(registry.oracle_sql()["a3_first_context"]).fetchall()}
