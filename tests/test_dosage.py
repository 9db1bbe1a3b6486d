"""Packed dosage rows: round trips, ranges that prune, choices of samples."""

import numpy as np
import pytest

from haplospark.operators import gram
from haplospark.sources import dosage


def test_two_bits_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 17):
        rows = rng.integers(-1, 3, (6, n)).astype(np.int8)
        packed = dosage.pack(rows)
        assert packed.shape == (6, -(-n // 4)) and (dosage.unpack(packed, np.arange(n)) == rows).all()
        assert (dosage.unpack(packed, np.array([n - 1, 0])) == rows[:, [n - 1, 0]]).all()


def test_ranges_and_samples(spark, tmp_path):
    rng = np.random.default_rng(2)
    ids = [f"s{k}" for k in range(9)]
    table = rng.integers(-1, 3, (60, 9))
    table[:, 0] = np.where(table[:, 0] == 0, 1, table[:, 0])
    calls = [(ids[s], v, None if table[v, s] < 0 else int(table[v, s])) for v in range(60) for s in range(9)]
    rows = gram.dosage_rows(spark.createDataFrame(calls, "sample string, variant long, dosage int"), ids).selectExpr("variant", "1 + variant % 2 as chrom", "variant * 10 as pos", "dosages")
    dosage.write_dosages(rows, ids, f"{tmp_path}/d", block=100)

    def read(*args, n=9, **kwargs):
        found = dosage.read_dosages(spark, f"{tmp_path}/d", *args, **kwargs)
        return {r.variant: np.frombuffer(r.dosages, np.int8).tolist() for r in found.collect()}, found

    whole, _ = read(1)
    assert whole == {v: table[v].tolist() for v in range(0, 60, 2)}
    part, found = read(2, 105, 330, samples=["s7", "s2"])
    assert part == {v: table[v, [7, 2]].tolist() for v in range(1, 60, 2) if 105 <= v * 10 < 330}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan and "PushedFilters" in plan and "pos" in plan
    opened = {r[0] for r in spark.read.parquet(f"{tmp_path}/d/rows").where("chrom = 2 and block >= 1 and block <= 3").selectExpr("_metadata.file_path").distinct().collect()}
    assert 0 < len(opened) <= 3
    assert read(1, 100, 100)[0] == {} and read(7)[0] == {}
    with pytest.raises(ValueError):
        read(1, samples=["s99"])
