"""The distributed decomposition against a dense one."""

import numpy as np
import pytest

from haplospark.operators import svd


def _dense(spark, n, v, seed, share=0.3):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 3, (n, v)) * (rng.random((n, v)) < share)
    a[:, : v // 4] += (np.arange(n) % 3 == 0)[:, None]
    a[:, v // 4 : v // 3] += 2 * (np.arange(n) % 5 == 0)[:, None]
    a[:, v // 3 : v // 2] += 2 * (np.arange(n) % 7 == 1)[:, None]
    calls = [(f"s{i:03d}", int(j) * 1000 - 7, int(a[i, j])) for i, j in zip(*np.nonzero(a))] + [("s000", 10**9, None), ("other", 5, 2)]
    train = np.arange(n) % 4 != 0
    samples = [(f"s{i:03d}", bool(train[i])) for i in range(n)]
    return a, train, spark.createDataFrame(calls, "sample string, variant long, dosage int").repartition(5), spark.createDataFrame(samples, "sample string, train boolean")


@pytest.mark.parametrize("calls_at_once", [1 << 15, 50])
def test_components_equal_a_dense_decomposition(spark, monkeypatch, calls_at_once):
    monkeypatch.setattr(svd, "CALLS", calls_at_once)
    a, train, calls, samples = _dense(spark, 40, 300, 1)
    got = svd.truncated_svd(calls, samples, 3, oversample=12, iterations=8)
    u, s, vt = np.linalg.svd(a[train].astype(float), full_matrices=False)
    assert np.allclose(got.values, s[:3], rtol=1e-6)
    want = a @ vt[:3].T
    far = want[train][np.abs(want[train]).argmax(0), range(3)]
    want *= np.sign(far)
    rows = {r.sample: r for r in got.projected.collect()}
    assert set(rows) == {f"s{i:03d}" for i in range(40)}
    for i in range(40):
        assert np.allclose(rows[f"s{i:03d}"].projection, want[i], atol=1e-4) and rows[f"s{i:03d}"].train == train[i]
    assert np.allclose(got.explained, want[train].var(0) / a[train].var(0).sum(), atol=1e-6)


def test_small_and_empty_tables(spark, monkeypatch):
    a, train, calls, samples = _dense(spark, 6, 9, 2)
    got = svd.truncated_svd(calls, samples, 20)
    assert np.allclose(got.values, np.linalg.svd(a[train].astype(float), compute_uv=False))
    none = svd.truncated_svd(calls.where("false"), samples, 2)
    assert not none.values.any() and not none.explained.any()
    assert all(r.projection == [0.0, 0.0] for r in none.projected.collect())
    monkeypatch.setattr(svd, "MAX_CELLS", 10)
    with pytest.raises(ValueError):
        svd.truncated_svd(calls, samples, 3)
