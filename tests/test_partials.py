"""Partial accumulators that are kept, resumed and merged; run records that are written again."""

import pytest

from haplospark.sources.tables import append_run, read_manifest
from haplospark.streaming.accumulate import accumulate_sources, accumulated, site_accumulators


def test_interrupted_and_whole_runs_agree(spark, tmp_path):
    calls = spark.range(900).selectExpr("concat('f', id % 7) as source", "id % 40 as site", "id % 9 as mc", "id % 9 + id % 3 as total").cache()
    sources = calls.select("source")
    read = lambda names: calls.where(calls.source.isin(names)).select("site", "mc", "total")
    folder, broken = f"{tmp_path}/kept", []

    def failing(names):
        if "f4" in names and not broken:
            broken.append(names)
            raise RuntimeError("lost")
        return read(names)

    with pytest.raises(RuntimeError):
        accumulate_sources(sources, failing, folder, batch=2)
    read(["f6"]).transform(site_accumulators).write.parquet(f"{folder}/batches/batch=left-over")  # without an entry in the ledger
    assert accumulate_sources(sources, failing, folder, batch=3) == 3
    assert accumulate_sources(sources, failing, folder, batch=3) == 0
    want = {r.site: tuple(r) for r in site_accumulators(calls).collect()}
    got = {r.site: tuple(r[c] for c in ("site", "n_obs", "sum_p", "sum_p2", "sum_noise", "sum_m", "sum_total", "n_seen")) for r in accumulated(spark, folder).collect()}
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_the_last_value_of_a_run_counts(spark, tmp_path):
    for step in (9, 10, 2):
        append_run(spark, {"run_id": "r", "step": step, "val": {"pearson": step / 10}}, f"{tmp_path}/runs")
    (row,) = read_manifest(spark, f"{tmp_path}/runs").collect()
    assert row["values"] == {"run_id": "r", "step": "2", "val.pearson": "0.2"}
