"""Linear models from moments: sums that merge map-side, so no group is ever gathered in a task.

One feature: each group keeps six sums (n, x, y, xx, xy, yy) for each fold, and leaving a
fold or a group out is a subtraction. Many features: each partition adds up one Gram
matrix, whose size depends on the features alone; the algebra on it is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "x", "y", "xx", "xy", "yy")


def moment_sums(x: str, y: str) -> list[Column]:
    """The six sums of a group, under the names of SUMS."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    values = {"n": F.lit(1.0), "x": a, "y": b, "xx": a * a, "xy": a * b, "yy": b * b}
    return [F.sum(values[k]).alias(k) for k in SUMS]


def slope(n: Column, x: Column, y: Column, xx: Column, xy: Column, l2: Column | float, l1: Column | float = 0.0) -> Column:
    """Slope with a free intercept: ridge penalty l2 and, by the soft threshold, lasso penalty l1 on centred sums."""
    sxy, sxx = xy - x * y / n, xx - x * x / n
    shrunk = F.signum(sxy) * F.greatest(F.abs(sxy) - l1, F.lit(0.0))
    return shrunk / (sxx + l2)


def squared_error(n: Column, x: Column, y: Column, xx: Column, xy: Column, yy: Column, b: Column, a: Column) -> Column:
    """Summed squared error of y against a + b x over rows known by their sums."""
    return yy - 2 * a * y - 2 * b * xy + n * a * a + 2 * a * b * x + b * b * xx


def gram(rows: DataFrame, features: str, by: str | None = None) -> dict[int, np.ndarray]:
    """The Gram matrix of array column features for each value of the integer column by (0 without one).

    Rows whose features are null, of another length than the first's, or not finite are
    left out; the groups are to be few (folds), as one matrix for each reaches the driver.
    """
    width = rows.where(F.col(features).isNotNull()).select(F.size(features)).first()
    if width is None:
        return {}
    d = width[0]
    key = F.col(by).cast("int") if by else F.lit(0)
    kept = rows.where(F.size(features) == d).select(key.alias("k"), F.col(features).cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            k = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.isfinite(v).all(axis=1)
            for group in np.unique(k[known]).tolist():
                m = v[known & (k == group)]
                sums[group] = sums.get(group, 0) + m.T @ m
        cells = [(g, i, x) for g, m in sums.items() for i, x in enumerate(m.ravel().tolist())]
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.float64()))], ["k", "i", "x"])

    out: dict[int, np.ndarray] = {}
    for k, i, x in kept.mapInArrow(add, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():  # d * d rows a group
        out.setdefault(k, np.zeros(d * d))[i] = x
    return {k: m.reshape(d, d) for k, m in out.items()}


def centred(g: np.ndarray) -> np.ndarray:
    """Centred cross products of a Gram matrix whose first feature is the constant one; the constant goes."""
    return g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(g[0, 0], 1.0)


def ridge_grid(folds: dict[int, np.ndarray], penalties: list[float]) -> list[tuple[float, float | None]]:
    """(penalty, mean held-out Pearson) of ridge with a free intercept.

    folds holds the Gram matrix of (1, features..., target) of each fold. A fold whose
    prediction or target is constant counts as 0; None without a fold to learn from.
    """
    if len(folds) < 2:
        return [(p, None) for p in penalties]
    total = sum(folds.values())
    out = []
    for p in penalties:
        scores = []
        for held in folds.values():
            train, test = centred(total - held), centred(held)
            w = np.linalg.lstsq(train[:-1, :-1] + p * np.eye(len(train) - 1), train[:-1, -1], rcond=None)[0]
            spread = (w @ test[:-1, :-1] @ w) * test[-1, -1]
            scores.append(float(w @ test[:-1, -1] / np.sqrt(spread)) if spread > 1e-12 else 0.0)
        out.append((p, float(np.mean(scores))))
    return out


def principal_axes(g: np.ndarray, k: int, centre: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, singular values) of the k leading components; g is the Gram matrix of (1, features...).

    Each axis is turned so that its largest component is positive.
    """
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n if centre else np.zeros(len(g) - 1)
    values, axes = np.linalg.eigh(centred(g) if centre else g[1:, 1:])
    order = np.argsort(-values)[:k]
    axes = axes[:, order].T
    lead = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return mean, axes * np.where(lead < 0, -1.0, 1.0)[:, None], np.sqrt(np.maximum(values[order], 0))
