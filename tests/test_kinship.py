"""Pair sums and filled vectors of calls against the definition."""

import numpy as np
import pytest

from haplospark.operators import kinship


@pytest.mark.parametrize("share, products", [(0.1, 1 << 22), (0.1, 50), (0.9, 1 << 22), (0.9, 50)])
def test_pair_sums_equal_the_product(share, products):
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((30, 40)) < share, rng.normal(size=(30, 40)), 0)
    sample, variant = np.nonzero(dense)
    order = np.argsort(variant, kind="stable")
    sample, variant = sample[order], variant[order]
    got, met = np.zeros((30, 30)), np.zeros((30, 30), bool)
    for i, j, k in kinship._pair_sums(sample * 7, variant, dense[sample, variant], products):
        assert (i <= j).all()
        np.add.at(got, (i // 7, j // 7), k)
        met[i // 7, j // 7] = True
    there = (dense != 0).astype(int)
    assert np.allclose(got, np.triu(dense @ dense.T)) and (met == (np.triu(there @ there.T) > 0)).all()


def test_blocks_keep_to_samples_that_meet(spark, monkeypatch):
    """Herds that share no variant: no matrix over all samples is made."""
    rng = np.random.default_rng(3)
    rows = [(h * 100 + s, h * 50 + v, float(rng.normal())) for h in range(4) for v in range(50) for s in rng.choice(100, 6, replace=False).tolist()]
    monkeypatch.setattr(kinship, "CALLS", 100)
    got = {(r.i, r.j): r.k for r in kinship.gram_blocks(spark.createDataFrame(rows, "sample long, variant long, z double"), 60).collect()}
    want = {}
    for i, v, a in rows:
        for j, w, b in rows:
            if v == w and i <= j:
                want[i, j] = want.get((i, j), 0) + a * b
    assert got == pytest.approx(want)


def test_filled_vectors_hold_what_the_dense_ones_do(spark):
    calls = spark.createDataFrame([(1, 5, 2), (3, 5, 1), (9, 6, 1)], "sample long, variant long, dosage long")
    samples = spark.createDataFrame([(k,) for k in (1, 3, 4, 9)], "sample long")
    for impute in ("ref", "mean"):
        dense = {r.variant: r.dosages for r in kinship.dosage_vectors(calls, samples, impute).collect()}
        for r in kinship.filled_dosages(calls, samples, impute).collect():
            row = [r.fill] * r.n
            for at, d in zip(r["at"], r.d):
                row[at] = d
            assert row == dense[r.variant]
