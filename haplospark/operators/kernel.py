"""Kernel models over samples: ridge on a kinship matrix for any number of traits.

The matrix over samples is a model's size, not the data's: it is taken only up to
MAX_SAMPLES and refused beyond, where svd.project on the variants fits the same model. It
comes as summed tiles (see gram.py). The traits, of which there may be any number, stay
distributed: a task takes blocks of them, and solves the system of a penalty once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a matrix that tasks share (8 bytes a pair: 64 MB).
MAX_SAMPLES = 2896
#: Cells of target vectors that a task holds at once.
BLOCK_CELLS = 4 << 20
#: The penalties among which leave-one-out chooses.
PENALTIES = np.logspace(-2, 3, 30)


def check_samples(n: int) -> None:
    if n > MAX_SAMPLES:
        raise ValueError(f"{n} samples; a shared matrix holds {MAX_SAMPLES} at most")


def target_vectors(values: DataFrame, ids: list[int]) -> DataFrame:
    """(trait, y array<double>) of values(trait, sample, value) in the order of ids; traits that lack a sample are left out."""
    order = values.sparkSession.createDataFrame([(x, n) for n, x in enumerate(ids)], f"sample {dict(values.dtypes)['sample']}, ord int")
    known = values.where("value is not null").join(F.broadcast(order), "sample")
    cells = known.groupBy("trait").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("value").cast("double").alias("v")))).alias("c"))  # a row a sample
    return cells.where(F.size("c") == len(ids)).select("trait", F.col("c.v").alias("y"))


class System:
    """The kernel system of one penalty, inverted once for all targets.

    With P the inverse of kernel + penalty, a target y has the weights P y, and what its
    prediction of a sample would miss without that sample is the weight over P's diagonal.
    """

    def __init__(self, kernel: np.ndarray, penalty: float):
        self.inverse = np.linalg.inv(kernel + penalty * np.eye(len(kernel)))
        self.own = np.diag(self.inverse)

    def weights(self, targets: np.ndarray) -> np.ndarray:
        return targets @ self.inverse

    def left_out(self, weights: np.ndarray) -> np.ndarray:
        """Mean squared error of each target, every sample predicted from the others."""
        return np.mean((weights / self.own) ** 2, axis=-1)


def choose_penalty(kernel: np.ndarray, targets: np.ndarray, penalties: np.ndarray = PENALTIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(penalty, leave-one-out error, weights) for each row of targets; of equal errors the first penalty wins."""
    penalty, least, weights = (np.zeros(len(targets)), np.full(len(targets), np.inf), np.zeros_like(targets))
    values, vectors = np.linalg.eigh(kernel)  # once: a penalty only adds to the values
    turned, squares = targets @ vectors, vectors**2
    for p in penalties:
        shrunk = 1 / (values + p)
        w = (turned * shrunk) @ vectors.T
        error = np.mean((w / (squares @ shrunk)) ** 2, axis=-1)
        better = error < least
        penalty[better], least[better], weights[better] = p, error[better], w[better]
    return penalty, least, weights


def _blocks(vectors: DataFrame, schema: str, fn: Callable[[pa.Array, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """fn(traits, y as a matrix) over blocks of target vectors of up to BLOCK_CELLS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return fn(table.column(0).combine_chunks(), np.array(table.column(1).to_pylist(), dtype=np.float64))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                cells += len(part.column(1).flatten())
                if cells >= BLOCK_CELLS:
                    yield close()
                    held, cells = [], 0
        if held:
            yield close()

    return vectors.select("trait", "y").mapInArrow(run, schema)


def blup(vectors: DataFrame, k: np.ndarray, train: np.ndarray, held: np.ndarray, penalties: np.ndarray = PENALTIES) -> DataFrame:
    """(trait, penalty, loo, y, predicted): kinship BLUP of each trait, its penalty chosen by leave-one-out.

    train and held are places in k; y and predicted are those of the held-out samples, in order.
    A trait's mean over its training samples is taken away first and added back.
    """
    check_samples(len(k))
    shared = vectors.sparkSession.sparkContext.broadcast((k[np.ix_(train, train)], k[np.ix_(train, held)]))
    name = dict(vectors.dtypes)["trait"]

    def fit(traits: pa.Array, y: np.ndarray) -> pa.RecordBatch:
        inner, cross = shared.value
        mean = y[:, train].mean(1, keepdims=True)
        penalty, loo, weights = choose_penalty(inner, y[:, train] - mean, penalties)
        lists = [pa.array(m.tolist(), pa.list_(pa.float64())) for m in (y[:, held], weights @ cross + mean)]
        return pa.RecordBatch.from_arrays([traits, pa.array(penalty), pa.array(loo), *lists], ["trait", "penalty", "loo", "y", "predicted"])

    return _blocks(vectors, f"trait {name}, penalty double, loo double, y array<double>, predicted array<double>", fit)


_MOMENTS = ("n", "a", "b", "aa", "bb", "ab")


def pooled_blup(vectors: DataFrame, k: np.ndarray, train: np.ndarray, held: np.ndarray, penalties: list[float], guard: float = 1e-3) -> DataFrame:
    """(penalty, n, pearson, r2) over all held-out cells of all traits, each trait scaled by its training mean and deviation.

    Traits whose training deviation is at most guard are left out. Only six sums a block
    and penalty leave a task.
    """
    check_samples(len(k))
    shared = vectors.sparkSession.sparkContext.broadcast((k[np.ix_(train, train)], k[np.ix_(train, held)]))

    def sums(_: pa.Array, y: np.ndarray) -> pa.RecordBatch:
        inner, cross = shared.value
        spread = y[:, train].std(1, ddof=1)
        y = y[spread > guard]
        scaled = (y - y[:, train].mean(1, keepdims=True)) / spread[spread > guard, None]
        truth = scaled[:, held]
        cells = []
        for p in penalties:
            guess = System(inner, p).weights(scaled[:, train]) @ cross
            cells.append((float(p), truth.size, truth.sum(), guess.sum(), (truth * truth).sum(), (guess * guess).sum(), (truth * guess).sum()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], ["penalty", *_MOMENTS])

    parts = _blocks(vectors, "penalty double, n long, a double, b double, aa double, bb double, ab double", sums)
    total = parts.groupBy("penalty").agg(*[F.sum(c).alias(c) for c in _MOMENTS]).where("n > 0")
    n, a, b, aa, bb, ab = (F.col(c) for c in _MOMENTS)
    spread = aa - a * a / n
    corr = (ab - a * b / n) / F.sqrt(spread * (bb - b * b / n))
    return total.select("penalty", "n", corr.alias("pearson"), (1 - (aa - 2 * ab + bb) / spread).alias("r2"))


def kinship_residual(vectors: DataFrame, k: np.ndarray, train: np.ndarray, penalty: float = 3.0, guard: float = 1e-3) -> DataFrame:
    """(trait, y): each trait scaled by its training mean and deviation, less what kinship predicts for every sample.

    The prediction is learned from the training samples. Traits whose training deviation is at most guard are left out.
    """
    check_samples(len(k))
    shared = vectors.sparkSession.sparkContext.broadcast((k[np.ix_(train, train)], k[train]))
    name = dict(vectors.dtypes)["trait"]

    def rest(traits: pa.Array, y: np.ndarray) -> pa.RecordBatch:
        inner, cross = shared.value
        spread = y[:, train].std(1, ddof=1)
        keep = spread > guard
        scaled = (y[keep] - y[keep][:, train].mean(1, keepdims=True)) / spread[keep, None]
        left = scaled - System(inner, penalty).weights(scaled[:, train]) @ cross
        return pa.RecordBatch.from_arrays([traits.filter(pa.array(keep)), pa.array(left.tolist(), pa.list_(pa.float64()))], ["trait", "y"])

    return _blocks(vectors, f"trait {name}, y array<double>", rest)


def impute_nearest(vectors: DataFrame, reference: np.ndarray, neighbours: int = 10) -> DataFrame:
    """(trait, y): the missing values of rows filled from the nearest rows of reference that know the value, by their mean.

    y may hold nulls. Distance is over the places that both rows know, scaled up to all of
    them; where no row of reference shares a place and knows the value, the place's mean
    over reference stands. reference is a bounded sample of rows (NaN: missing), shared by
    the tasks; a row that is in it itself is at distance 0, but does not know its own missing places.
    """
    if reference.nbytes > 64 << 20:
        raise ValueError("reference rows beyond 64 MB")
    there = ~np.isnan(reference)
    filled = np.where(there, reference, 0.0)
    with np.errstate(invalid="ignore"):
        means = filled.sum(0) / there.sum(0)
    name = dict(vectors.dtypes)["trait"]

    def fill(traits: pa.Array, y: np.ndarray) -> pa.RecordBatch:
        for row in y:
            known = ~np.isnan(row)
            if known.all():
                continue
            shared = (there & known).sum(1)
            gaps = ((filled - np.where(known, row, 0.0)) ** 2 * (there & known)).sum(1)
            far = np.where(shared > 0, gaps / np.maximum(shared, 1) * len(row), np.inf)
            order = np.argsort(far, kind="stable")
            for place in np.flatnonzero(~known):
                near = [r for r in order if there[r, place] and np.isfinite(far[r])][:neighbours]
                row[place] = reference[near, place].mean() if near else means[place]
        return pa.RecordBatch.from_arrays([traits, pa.array(y.tolist(), pa.list_(pa.float64()))], ["trait", "y"])

    return _blocks(vectors, f"trait {name}, y array<double>", fill)
