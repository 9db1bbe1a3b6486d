"""Gram tiles, cis models and elastic net against direct algebra."""

import numpy as np
import pytest

from haplospark.operators import cis, elastic_net, gram, kernel


def _plain_standardise(rows, parts, maf_min=0.0):
    out = []
    for row in rows:
        known = row[row >= 0].astype(float)
        if not len(known):
            continue
        af = known.mean() / 2
        if min(af, 1 - af) < maf_min:
            continue
        x = np.where(row >= 0, row, 2 * af).astype(float)
        for part in set(parts):
            own = parts == part
            x[own] = (x[own] - x[own].mean()) / (x[own].std() or 1.0)
        out.append(x)
    return np.array(out).reshape(-1, len(parts))


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(7)
    n, variants = 24, 90
    dosages = rng.integers(0, 3, (variants, n))
    dosages[5], dosages[6, :] = 0, 2  # constant
    missing = rng.random((variants, n)) < 0.05
    calls = [(f"s{s:02d}", v, None if missing[v, s] else int(dosages[v, s])) for v in range(variants) for s in range(n) if missing[v, s] or dosages[v, s]]
    rows = np.where(missing, -1, dosages).astype(np.int8)
    ids = [f"s{s:02d}" for s in range(n)]
    parts = (np.arange(n) % 4 == 0).astype(int)
    table = gram.dosage_rows(spark.createDataFrame(calls, "sample string, variant long, dosage int").repartition(3), ids)
    pos = np.arange(variants) * 10
    placed = table.selectExpr("variant", "dosages", "1 + variant % 2 as chrom", "variant * 10 as pos")
    genes = [(g, 1 + g % 2, g * 100) for g in range(9)] + [(50, 1, 10**6)]
    effect = rng.normal(size=variants) * (rng.random(variants) < 0.1)
    values = {g: (dosages * effect[:, None]).sum(0) + rng.normal(size=n) for g, _, _ in genes}
    cells = [(g, ids[s], float(y[s])) for g, y in values.items() for s in range(n) if not (g == 3 and s in (1, 4))]
    cells += [(70, ids[1], 1.0), (70, ids[0], 2.0)]  # too few to train on
    genes.append((70, 1, 100))
    targets = cis.gene_targets(spark.createDataFrame(cells, "gene int, sample string, value double").repartition(2), ids)
    return {
        "rows": rows, "parts": parts, "table": placed, "genes": genes, "values": values, "targets": targets, "ids": ids, "pos": pos,
        "windows": cis.windows(placed, spark.createDataFrame(genes, "gene int, chrom long, tss long"), 150),
    }


def _near(study, gene):
    chrom, tss = next((c, t) for g, c, t in study["genes"] if g == gene)
    return [v for v in range(len(study["rows"])) if 1 + v % 2 == chrom and abs(study["pos"][v] - tss) <= 150]


def _held_out(study, gene):
    y = study["values"][gene].copy()
    if gene == 3:
        y[[1, 4]] = np.nan
    return y


def test_dosage_rows_and_kinship(spark, study):
    found = {r.variant: np.frombuffer(r.dosages, np.int8) for r in study["table"].collect()}
    for v, row in enumerate(study["rows"]):
        assert (v not in found and (row == 0).all()) or (found[v] == row).all()
    there = np.array([row for v, row in enumerate(study["rows"]) if v in found])
    for parts, maf in ((study["parts"], 0.0), (np.zeros(24, int), 0.2)):
        z = _plain_standardise(there, parts, maf)
        assert np.allclose(gram.kinship(study["table"], parts, maf), z.T @ z / len(z))


def test_kinship_in_several_tiles(spark, study, monkeypatch):
    whole = gram.kinship(study["table"], study["parts"])
    monkeypatch.setattr(gram, "TILE", 7)
    assert np.allclose(gram.kinship(study["table"], study["parts"]), whole)
    with pytest.raises(ValueError):
        gram.kinship(study["table"], np.zeros(kernel.MAX_SAMPLES + 1, int))
    with pytest.raises(ValueError):
        gram.dosage_rows(study["table"].selectExpr("'a' as sample", "variant", "1 as dosage"), ["a"], "median")
    mean = gram.dosage_rows(spark.createDataFrame([("a", 1, 2), ("c", 1, 0)], "sample string, variant int, dosage int"), ["a", "b", "c"], "mean")
    assert np.frombuffer(mean.first().dosages, np.int8).tolist() == [2, -1, 0]


@pytest.mark.parametrize("part_variants", [100_000, 4])
def test_kernel_models_equal_direct_algebra(spark, study, monkeypatch, part_variants):
    monkeypatch.setattr(cis, "PART_VARIANTS", part_variants)
    parts, rows = study["parts"], study["rows"]
    there = {r.variant for r in study["table"].collect()}
    relatives = gram.kinship(study["table"], parts)
    found = {r.gene: r for r in cis.kernel_models(study["windows"], study["targets"], parts, relatives, maf_min=0.02, penalties=np.array([0.1, 1.0, 10.0])).collect()}
    assert set(found) == {g for g, _, _ in study["genes"]}
    assert found[50].n_cis == 0 and found[50].predicted is None and found[50].cis_h2 is None
    assert found[70].n_cis > 0 and found[70].predicted is None and found[70].y[0] == 2.0
    for gene in range(9):
        y, row = _held_out(study, gene), found[gene]
        z = _plain_standardise(rows[[v for v in _near(study, gene) if v in there]], parts, 0.02)
        assert row.n_cis == len(z)
        k = z.T @ z / len(z)
        train = [s for s in range(24) if parts[s] == 0 and np.isfinite(y[s])]
        held = [s for s in range(24) if parts[s]]
        c = y[train] - y[train].mean()
        pairs = [(i, j) for i in range(len(train)) for j in range(i + 1, len(train))]
        a = np.array([[k[train[i], train[j]], relatives[train[i], train[j]], 1.0] for i, j in pairs])
        t = np.array([c[i] * c[j] / c.var() for i, j in pairs])
        slopes = np.clip(np.linalg.lstsq(a, t, rcond=None)[0][:2], 0, 1)
        assert np.allclose([row.cis_h2, row.glob_h2], slopes)
        errors = []
        for p in (0.1, 1.0, 10.0):
            gaps = []
            for i in range(len(train)):
                rest = [s for s in train if s != train[i]]
                w = np.linalg.solve(k[np.ix_(rest, rest)] + p * np.eye(len(rest)), np.delete(c, i))
                gaps.append(c[i] - k[train[i], rest] @ w)
            errors.append(np.mean(np.square(gaps)))
        best = (0.1, 1.0, 10.0)[int(np.argmin(errors))]
        assert row.penalty == best
        w = np.linalg.solve(k[np.ix_(train, train)] + best * np.eye(len(train)), c)
        assert np.allclose(row.predicted, k[np.ix_(held, train)] @ w + y[train].mean())
        assert [x if x is not None else np.nan for x in row.y] == pytest.approx(y[held], nan_ok=True)


def test_sparse_models_and_screening(spark, study):
    parts, rows = study["parts"], study["rows"]
    there = {r.variant for r in study["table"].collect()}
    for screen in (3000, 5):
        found = {r.gene: r for r in cis.sparse_models(study["windows"], study["targets"], parts, screen=screen).collect()}
        assert found[50].n_cis == 0 and found[50].predicted is None
        for gene in (0, 3, 8):
            y, row = _held_out(study, gene), found[gene]
            z = _plain_standardise(rows[[v for v in _near(study, gene) if v in there]], parts)
            train = np.array([s for s in range(24) if parts[s] == 0 and np.isfinite(y[s])])
            assert row.n_cis == len(z) and row.n_used == min(screen, len(z))
            if screen < len(z):
                strength = np.abs(z[:, train] @ (y[train] - y[train].mean()))
                z = z[np.sort(np.argsort(-strength.round(9), kind="stable")[:screen])]
            penalty, w, b = elastic_net.cross_validated(z[:, train].T, y[train])
            assert row.penalty == pytest.approx(penalty) and row.n_nonzero == (w != 0).sum()
            assert np.allclose(row.predicted, z[:, parts != 0].T @ w + b, atol=1e-5)


def test_elastic_net_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 90)) + rng.normal(size=(40, 1))
    x[:, 7] = 3.0  # constant
    y = x[:, :4] @ [1.0, -2.0, 0.5, 1.0] + rng.normal(size=40) + 5
    penalties = elastic_net.penalty_grid(x, y)
    c, t = x - x.mean(0), y - y.mean()
    for p, (w, b) in zip(penalties, elastic_net.path(x, y, penalties)):
        slope = c.T @ (t - c @ w) - 40 * p * 0.5 * w  # must be the sign times the l1 penalty where w is not 0
        used = w != 0
        assert np.allclose(slope[used], np.sign(w[used]) * 40 * p * 0.5, atol=1e-3)
        assert (np.abs(slope[~used]) <= 40 * p * 0.5 * (1 + 1e-5) + 1e-9).all()
        assert b == pytest.approx(y.mean() - x.mean(0) @ w)
    assert not elastic_net.path(x, y, penalties[:1] * 1.0001)[0][0].any()
    chosen, w, b = elastic_net.cross_validated(x, y)
    errors = np.zeros(12)
    for held in (range(0, 14), range(14, 27), range(27, 40)):
        rest = [i for i in range(40) if i not in held]
        for k, (v, a) in enumerate(elastic_net.path(x[rest], y[rest], penalties)):
            errors[k] += ((y[list(held)] - x[list(held)] @ v - a) ** 2).mean()
    assert chosen == penalties[errors.argmin()]


def test_residual_of_kinship(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(12, 30))
    k, y = z @ z.T / 30, rng.normal(size=(4, 12))
    y[3] = 2.0
    train = np.arange(8)
    vectors = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(y)], "trait int, y array<double>")
    found = {r.trait: r.y for r in kernel.kinship_residual(vectors, k, train, 3.0).collect()}
    assert set(found) == {0, 1, 2}
    for t in range(3):
        s = (y[t] - y[t, train].mean()) / y[t, train].std(ddof=1)
        assert np.allclose(found[t], s - k[:, train] @ np.linalg.solve(k[np.ix_(train, train)] + 3.0 * np.eye(8), s[train]))


def test_penalties_share_one_decomposition(monkeypatch):
    rng = np.random.default_rng(12)
    z = rng.normal(size=(30, 20))
    y = rng.normal(size=(4, 20))
    inverse = np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda m: pytest.fail("an inverse for each penalty"))
    penalty, least, weights = kernel.choose_penalty(z.T @ z / 30, y)
    for k in range(4):
        found = []
        for p in kernel.PENALTIES:
            inner = inverse(z.T @ z / 30 + p * np.eye(20))
            found.append((np.mean((inner @ y[k] / np.diag(inner)) ** 2), p, inner @ y[k]))
        error, p, w = min(found, key=lambda f: f[0])
        assert penalty[k] == p and least[k] == pytest.approx(error) and np.allclose(weights[k], w)


@pytest.mark.parametrize("ratio", [0.5, 0.95])
def test_elastic_net_is_exact_along_the_path(ratio):
    rng = np.random.default_rng(13)
    x = rng.integers(0, 3, (60, 40)).astype(float)
    x[:, 7], x[:, 9] = x[:, 3], 1.0  # an equal and a constant feature
    y = x @ (rng.normal(size=40) * (rng.random(40) < 0.3)) + rng.normal(size=60)
    centred = x - x.mean(0)
    for p, (w, b) in zip(grid := elastic_net.penalty_grid(x, y, ratio), elastic_net.path(x, y, grid, ratio)):
        pull = centred.T @ (y - x @ w - b) - 60 * p * (1 - ratio) * w
        assert np.abs(pull[w != 0] - 60 * p * ratio * np.sign(w[w != 0])).max(initial=0) < 1e-9 * 60 * grid[0]
        assert (np.abs(pull) <= 60 * p * ratio * (1 + 1e-5)).all()
