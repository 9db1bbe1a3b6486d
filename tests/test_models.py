"""Kernel models, models given as objects, and streaming windows against direct versions."""

import numpy as np
import pytest

from haplospark.operators import estimators, kernel
from haplospark.operators.windows import greedy_windows
from haplospark.streaming.windows import follow_metrics, stream_windows


def _kinship(n, seed=0):
    z = np.random.default_rng(seed).normal(size=(n, 40))
    return z @ z.T / 40


def _vectors(spark, y):
    return spark.createDataFrame([(t, [None if x != x else float(x) for x in row]) for t, row in enumerate(y)], "trait int, y array<double>")


def test_blup_chooses_by_refitting_without_each_sample(spark):
    k, rng = _kinship(14), np.random.default_rng(1)
    y = rng.normal(size=(5, 14))
    train, held, penalties = np.arange(10), np.arange(10, 14), np.array([0.1, 1.0, 10.0])
    rows = kernel.blup(_vectors(spark, y), k, train, held, penalties).collect()
    assert len(rows) == 5
    for r in rows:
        own = y[r["trait"], train]
        c = own - own.mean()
        errors = []
        for p in penalties:
            gaps = []
            for i in train:
                rest = np.delete(train, i)
                gaps.append(c[i] - k[i, rest] @ np.linalg.solve(k[np.ix_(rest, rest)] + p * np.eye(9), c[rest]))
            errors.append(np.mean(np.square(gaps)))
        assert r["penalty"] == penalties[np.argmin(errors)]
        assert r["loo"] == pytest.approx(min(errors))
        direct = k[np.ix_(held, train)] @ np.linalg.solve(k[np.ix_(train, train)] + r["penalty"] * np.eye(10), c) + own.mean()
        assert np.allclose(r["predicted"], direct)
    assert kernel.blup(_vectors(spark, []), k, train, held).count() == 0


def test_pooled_blup(spark):
    k, y = _kinship(12, 2), np.random.default_rng(3).normal(size=(6, 12))
    y[5] = 7.0  # constant: left out
    train, held = np.arange(9), np.arange(9, 12)
    (row,) = kernel.pooled_blup(_vectors(spark, y), k, train, held, [0.5]).collect()
    z = (y[:5] - y[:5, train].mean(1, keepdims=True)) / y[:5, train].std(1, ddof=1, keepdims=True)
    p = z[:, train] @ np.linalg.solve(k[np.ix_(train, train)] + 0.5 * np.eye(9), k[np.ix_(train, held)])
    a, b = z[:, held].ravel(), p.ravel()
    assert row["n"] == 15
    assert row["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert row["r2"] == pytest.approx(1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_vectors_and_bounds(spark):
    with pytest.raises(ValueError):
        kernel.blup(_vectors(spark, []), np.zeros((kernel.MAX_SAMPLES + 1, 1)), np.arange(1), np.arange(1))
    values = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 4.0), ("b", 1, 1.0), ("c", 1, None), ("c", 2, 1.0), ("a", 9, 1.0)], "trait string, sample long, value double")
    assert [tuple(r) for r in kernel.target_vectors(values, [1, 2]).collect()] == [("a", [4.0, 5.0])]


def test_impute_nearest(spark):
    nan = np.nan
    y = np.array([[1.0, nan, 3.0], [1.0, 2.0, 3.1], [9.0, 8.0, nan], [1.1, 4.0, 3.0], [nan, nan, nan]])
    got = {r["trait"]: r["y"] for r in kernel.impute_nearest(_vectors(spark, y), y, 2).collect()}
    assert got[0] == [1.0, 3.0, 3.0]  # from rows 1 and 3
    assert got[1] == [1.0, 2.0, 3.1]
    assert got[2] == pytest.approx([9.0, 8.0, (3.0 + 3.1) / 2])
    assert got[4] == pytest.approx(np.nanmean(y, axis=0).tolist())  # shares no place with any row


def _trait_rows(spark, n=24):
    rng = np.random.default_rng(5)
    rows, x = [], rng.normal(size=(n, 3))
    for trait in ("a", "b"):
        y = x @ rng.normal(size=3) + (1 if trait == "a" else 0)
        for s in range(n):
            rows.append((trait, s, x[s].tolist(), None if s == 3 else float(y[s]), "train" if s % 3 else "test", s % 4))
    rows.append(("c", 0, [0.0, 0.0, 0.0], 1.0, "train", 0))
    rows.append(("c", 1, [0.0, 0.0, 0.0], 1.0, "test", None))
    return spark.createDataFrame(rows, "trait string, sample int, x array<double>, y double, part string, fold int"), rows


def test_estimators(spark):
    df, rows = _trait_rows(spark)
    full = estimators.by_estimator(lambda: estimators.PartialLeastSquares(3))  # all components: least squares
    got = estimators.fit_by_trait(df, full).collect()
    assert len(got) == sum(r[4] == "test" for r in rows)
    assert all(r["predicted"] is None for r in got if r["trait"] == "c")
    for r in got:
        if r["trait"] != "c" and r["target"] is not None:
            assert r["predicted"] == pytest.approx(r["target"])
    s = {r["trait"]: r for r in estimators.scores(estimators.fit_by_trait(df, full)).collect()}
    assert s["a"]["r2"] == pytest.approx(1.0) and s["a"]["n"] == 7
    held = estimators.cross_validate(df, full, 4)
    assert held.where("trait <> 'c'").count() == 48
    assert held.where("trait = 'c'").count() == 1  # the row without a fold is not predicted


def test_models_of_the_same_rows_share_one_gathering(spark):
    rows, _ = _trait_rows(spark)
    makers = {"ridge": lambda: estimators.KernelRidge(1.0), "pls": lambda: estimators.PartialLeastSquares(2)}
    models = {name: estimators.by_estimator(make) for name, make in makers.items()}
    found = estimators.fit_models(rows, models)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    for name, fit in models.items():
        want = sorted(map(str, estimators.fit_by_trait(rows, fit).collect()))
        assert sorted(map(str, found.where(f"model = '{name}'").drop("model").collect())) == want and want


def test_kernel_ridge():
    rng = np.random.default_rng(6)
    x, y, new = rng.normal(size=(8, 2)), rng.normal(size=8), rng.normal(size=(3, 2))
    got = estimators.KernelRidge(0.3, 0.7).fit(x, y).predict(new)
    k = lambda a, b: np.exp(-0.7 * ((a[:, None] - b[None]) ** 2).sum(-1))
    assert np.allclose(got, k(new, x) @ np.linalg.solve(k(x, x) + 0.3 * np.eye(8), y - y.mean()) + y.mean())


def test_streamed_windows_equal_those_of_the_whole(spark, tmp_path):
    rng = np.random.default_rng(7)
    pos = {c: np.unique(rng.integers(0, 900, 120)) for c in (1, 2)}
    source = str(tmp_path / "sites")
    for part in range(4):
        rows = [(c, int(p)) for c, ps in pos.items() for p in ps[part * len(ps) // 4 : (part + 1) * len(ps) // 4]]
        rng.shuffle(rows)
        rows = [(int(c), int(p)) for c, p in rows] + ([(1, None), (2, None)] if part == 3 else [])
        spark.createDataFrame(rows, "chrom int, pos long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("chrom int, pos long").option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_windows(stream, 25).writeStream.format("memory").queryName("found_windows").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("found_windows").collect()))
    whole = spark.createDataFrame([(c, int(p)) for c, ps in pos.items() for p in ps], "chrom int, pos long")
    assert got == sorted(map(tuple, greedy_windows(whole, 25).collect()))


def test_metrics_are_followed(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    checkpoint = str(tmp_path / "c")
    take = lambda rows, _: seen.extend(r["step"] for r in rows.collect())
    for step in (1, 2):
        spark.createDataFrame([(step, 0.5)], "step int, loss double").write.mode("append").json(log)
        follow_metrics(spark, log, "step int, loss double", take, checkpoint, once=True).awaitTermination(60)
    assert seen == [1, 2]
