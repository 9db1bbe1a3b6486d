"""Greedy windows by ranges against the rule walked one site after another."""

import random

import pytest

from pyspark.sql import functions as F

from haplospark.operators.interval import nearest_marked
from haplospark.operators.windows import greedy_windows


def walked(positions, half, mode, buffer):
    out, last_end, left = [], None, sorted(set(positions))
    while left:
        p = left[0]
        start = p - half
        if mode == "disjoint" and last_end is not None and start < last_end:
            start = last_end
        end = start + 2 * half
        inside = [q for q in left if (q < end if mode == "disjoint" else q <= p + half - buffer)]
        out.append((start, end, len(inside)))
        left, last_end = left[len(inside) :], end
    return out


@pytest.mark.parametrize("half, mode, buffer", [(25, "disjoint", 0), (25, "overlap", 5), (1, "disjoint", 0), (3, "overlap", 0), (400, "disjoint", 0), (400, "overlap", 399)])
def test_ranges_of_any_size_give_the_same_windows(spark, half, mode, buffer):
    rng = random.Random(half)
    cases = {
        1: [rng.randrange(3000) for _ in range(900)],  # dense
        2: [rng.randrange(60000) for _ in range(150)],  # gaps of many ranges
        3: [k * 2 * half for k in range(40)] + [k * 2 * half + half for k in range(40)],
        4: [0], 5: [-500, -499, -20, 7], 6: [127, 128, 129, 255, 256, 383, 384],
    }
    rows = [(c, p) for c, ps in cases.items() for p in ps + ps[:3]] + [(None, 5), (1, None)]
    sites = spark.createDataFrame(rows, "chrom int, pos long").repartition(3)
    want = sorted((c, *w) for c, ps in cases.items() for w in walked(ps, half, mode, buffer))
    for bases in (128, 1000, 1 << 20):
        assert sorted(tuple(r) for r in greedy_windows(sites, half, mode, buffer, bases).collect()) == want
    assert greedy_windows(sites.where("false"), half, mode, buffer).count() == 0


def test_a_broadcast_join_keeps_ranges_whole(spark, tmp_path):
    rng = random.Random(8)
    cases = {c: [rng.randrange(90000) for _ in range(20000)] for c in (1, 2)}
    spark.createDataFrame([(c, p) for c, ps in cases.items() for p in ps], "chrom int, pos long").repartition(4).write.parquet(f"{tmp_path}/sites")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in greedy_windows(spark.read.parquet(f"{tmp_path}/sites"), 25).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted((c, *w) for c, ps in cases.items() for w in walked(ps, 25, "disjoint", 0))


def test_modes_are_checked(spark):
    sites = spark.createDataFrame([(1, 5)], "chrom int, pos long")
    for mode, buffer in (("disjoint", 1), ("overlap", 25), ("other", 0)):
        with pytest.raises(ValueError):
            greedy_windows(sites, 25, mode, buffer)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_nearest_marked_equals_a_walk(spark, width):
    rng = random.Random(width)
    rows = [(c, p, bool(m)) for c in (1, 2, 3) for p, m in {rng.randrange(-50, 300): rng.random() < 0.1 and c < 3 for _ in range(120)}.items()]
    df = spark.createDataFrame(rows, "chrom int, pos long, m boolean")
    want = {(c, p): min((q for k, q, m in rows if m and k == c), key=lambda q: (abs(q - p), q), default=None) for c, p, _ in rows}
    found = nearest_marked(df, F.col("m"), width)
    assert {(r.chrom, r.pos): r.nearest for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("$", "")  # such a frame is walked anew for each row
