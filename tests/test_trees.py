"""Trees grown by aggregates against trees grown row by row."""

import random

import numpy as np
import pytest

from haplospark.operators import trees


def _tree(x, t, w, depth):
    """Predictions of a tree on binned rows, grown recursively."""
    out = np.zeros(len(x))

    def grow(own, left):
        learned = own[w[own] > 0]
        if not len(learned):
            return
        n, s = w[learned].sum(), (w[learned] * t[learned]).sum()
        best = (0.0, None, None)
        for f in range(x.shape[1]) if left else ():
            for cut in sorted(set(x[learned, f]))[:-1]:
                low = learned[x[learned, f] <= cut]
                a, b = w[low].sum(), (w[low] * t[low]).sum()
                gain = round(b * b / a + (s - b) ** 2 / (n - a) - s * s / n, 9)
                if gain > max(best[0], 1e-9):
                    best = (gain, f, cut)
        if best[1] is None:
            out[own] = s / n
            return
        grow(own[x[own, best[1]] <= best[2]], left - 1)
        grow(own[x[own, best[1]] > best[2]], left - 1)

    grow(np.arange(len(x)), depth)
    return out


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(3)
    rows = []
    for trait in ("a", "b"):
        for k in range(45):
            x = [rng.randrange(4) for _ in range(3)]
            y = None if k == 5 else float(x[0] * 2 + (x[1] > 1) * x[2] + (trait == "b") * x[2]) + rng.random()
            rows.append((trait, k, x, y, k % 3 != 0))
    return rows, spark.createDataFrame(rows, "trait string, sample int, bins array<int>, y double, train boolean").repartition(3)


def test_boosting_equals_recursion(cases):
    rows, df = cases
    got = {(r.trait, r.sample): r.predicted for r in trees.boosted(df, ["trait"], 3, 2, 0.5).collect()}
    for trait in ("a", "b"):
        own = [r for r in rows if r[0] == trait]
        x, y = np.array([r[2] for r in own]), np.array([np.nan if r[3] is None else r[3] for r in own])
        w = np.array([float(r[4] and r[3] is not None) for r in own])
        guess = np.full(len(own), y[w > 0].mean())
        for _ in range(3):
            guess = guess + 0.5 * _tree(x, np.nan_to_num(y - guess), w, 2)
        assert [got[trait, r[1]] for r in own] == pytest.approx(guess.tolist())


def test_forest_equals_recursion(spark, cases):
    rows, df = cases
    weights = {(r.trait, r.sample, r.tree): r.w for r in df.selectExpr("trait", "sample", "explode(sequence(0, 3)) as tree").select("*", trees.drawn_weight(*[trees.F.lit(0), trees.F.col("tree"), trees.F.col("trait"), trees.F.col("sample")]).alias("w")).collect()}
    assert 0.7 < np.mean(list(weights.values())) < 1.3
    got = {(r.trait, r.sample): r.predicted for r in trees.forest(df, ["trait"], 4, 3).collect()}
    for trait in ("a", "b"):
        own = [r for r in rows if r[0] == trait]
        x, y = np.array([r[2] for r in own]), np.array([0.0 if r[3] is None else r[3] for r in own])
        each = [_tree(x, y, np.array([weights[trait, r[1], k] * float(r[4] and r[3] is not None) for r in own]), 3) for k in range(4)]
        assert [got[trait, r[1]] for r in own] == pytest.approx(np.mean(each, axis=0).tolist())


def test_bins_and_empty_groups(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0], k < 60) for k in range(80)], "sample int, x array<double>, train boolean")
    got = {r["sample"]: r.bins for r in trees.binned(df, "x", 4).collect()}
    assert [got[k][0] for k in (0, 14, 16, 29, 31, 44, 46, 79)] == [0, 0, 1, 1, 2, 2, 3, 3] and all(b[1] == 0 for b in got.values())
    twice = spark.createDataFrame([("a", 1, [k % 2], float(k), k < 6) for k in range(8)], "trait string, sample int, bins array<int>, y double, train boolean")
    assert sorted(r.y for r in trees.forest(twice, ["trait"], 3, 1).collect()) == [float(k) for k in range(8)]
    none = spark.createDataFrame([("a", 1, [0], None, True)], "trait string, sample int, bins array<int>, y double, train boolean")
    assert trees.forest(none, ["trait"], 2, 2).first().predicted is None
    assert trees.boosted(none, ["trait"], 2, 2).count() == 0


def test_rows_are_written_once(cases, monkeypatch):
    """What is written follows the rows, not the trees, levels and rounds."""
    _, df = cases
    sizes = []
    for name in ("stored", "written"):
        monkeypatch.setattr(trees, name, lambda rows, real=getattr(trees, name): (out := real(rows), sizes.append(out.count()))[0])
    trees.forest(df, ["trait"], 4, 3).collect()
    trees.boosted(df, ["trait"], 5, 3).collect()
    assert sum(n >= df.count() for n in sizes) == 2


def test_no_depth_and_no_features_give_the_mean(spark):
    rows = [("a", k, [], float(k), True) for k in range(4)]
    df = spark.createDataFrame(rows, "trait string, sample int, bins array<int>, y double, train boolean")
    assert {r.predicted for r in trees.boosted(df, ["trait"], 2, 2).collect()} == {1.5}
    one = spark.createDataFrame([(t, k, [k], y, tr) for t, k, _, y, tr in rows], df.schema)
    assert {r.predicted for r in trees.boosted(one, ["trait"], 2, 0).collect()} == {1.5}


def test_trees_grow_on_cells(spark, monkeypatch):
    """Rows of equal bins are one cell, whether features are null or not; what is not drawn does not count."""
    rows = [("a", k, [k % 2, None if k % 3 else 1], float(k % 2) + (k == 7), k % 5 != 0) for k in range(60)] + [("a", 60, None, 1.0, True), ("a", 61, None, 9.0, False)]
    df = spark.createDataFrame(rows, "trait string, sample int, bins array<int>, y double, train boolean").repartition(3)
    seen, grown = [], trees._grown
    monkeypatch.setattr(trees, "_grown", lambda rows, *rest: (seen.append(rows.count()), grown(rows, *rest))[1])
    got = {r["sample"]: r for r in trees.boosted(df, ["trait"], 2, 1, 1.0).collect()}
    assert len(got) == 62 and got[61].y == 9.0 and got[61].predicted == got[60].predicted and seen == [5, 5]
    assert got[0].predicted == pytest.approx(got[2].predicted) and got[1].predicted > 0.9
    monkeypatch.setattr(trees, "TREES", 2)  # trees in passes give the same
    few = {r["sample"]: r.predicted for r in trees.forest(df, ["trait"], 3, 2).collect()}
    assert len(few) == 62 and seen[2] <= 15
    monkeypatch.setattr(trees, "TREES", 8)
    assert {r["sample"]: r.predicted for r in trees.forest(df, ["trait"], 3, 2).collect()} == pytest.approx(few)
