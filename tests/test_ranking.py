"""Numbers, ranks and counts by ranges against whole sorts."""

import random

from pyspark.sql import functions as F

from haplospark.operators.ranking import average_ranks, counted_ranks, row_numbers
from haplospark.operators.windows import near_counts
from haplospark.plans import registry


def test_numbers_run_through_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(700)] + [("c", 1, 9000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r.id: (r.rn, r.n) for r in row_numbers(df, ["g"], ["v", "id"], "rn", "n").collect()}
    for g in ("a", "b", None, "c"):
        own = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    everything = {r.id: r.rn for r in row_numbers(df, [], [F.md5(F.col("id").cast("string"))]).collect()}
    assert sorted(everything.values()) == list(range(1, len(rows) + 1))
    assert row_numbers(df.where("false"), ["g"], ["v"]).count() == 0
    assert row_numbers(df, ["g"], ["v"]).columns == ["g", "v", "id", "rn"]


def test_average_ranks(spark):
    rng = random.Random(2)
    rows = [(k % 3, float(rng.randrange(9)), k) for k in range(300)]
    got = {r.id: r["rank"] for r in average_ranks(spark.createDataFrame(rows, "g int, v double, id int").repartition(4), "v", ["g"]).collect()}
    for g, v, k in rows:
        own = [x for h, x, _ in rows if h == g]
        assert got[k] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2


def test_near_counts(spark):
    rng = random.Random(3)
    sites = {(c, rng.randrange(-300, 900)) for c in (1, 2) for _ in range(200)}
    for bases in (7, 64, 1 << 20):
        got = near_counts(spark.createDataFrame(sorted(sites), "chrom int, pos long"), 20, bases).collect()
        assert {(r.chrom, r.pos): r.near for r in got} == {(c, p): sum(d == c and abs(p - q) <= 20 for d, q in sites) for c, p in sites} and len(got) == len(sites)


def test_counted_ranks_and_nulls(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *map(float, range(9))]), k) for k in range(300)]
    got = {r.id: r["rank"] for r in counted_ranks(spark.createDataFrame(rows, "g int, v double, id int").repartition(4), "v", ["g"]).collect()}
    for g, v, k in rows:
        own = [float("inf") if x is None else x for h, x, _ in rows if h == g]
        v = float("inf") if v is None else v
        assert got[k] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
    items = [(k % 7, 1, 1, 1, rng.random(), float(rng.randrange(5))) for k in range(50)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.queries()["a30_correlations"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan  # a whole group in one task
