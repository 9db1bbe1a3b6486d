"""Truncated singular value decomposition of a sparse matrix of any width.

Rows are samples, columns variants, and calls(sample, variant, dosage) has a row for each
entry that is not zero. A randomised range finder with power iteration needs nothing of
the matrix A but A (A' Q): the calls are dealt by variant once, and a task that holds a
variant's calls takes its row of A' Q and adds what it brings to A (A' Q), so one pass is
one job, no column leaves its task, and only samples by components come together. Those
are a model's size; MAX_CELLS bounds them, and the tasks share them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.ranking import row_numbers
from haplospark.operators.stored import stored

#: Cells of a matrix of samples by components that tasks share (8 bytes each).
MAX_CELLS = 8 << 20
#: Calls that a task multiplies at once.
CALLS = 1 << 15


@dataclass
class Decomposition:
    """values: singular values over the training rows; explained: the share of variance of each component; projected: (sample, projection array<double>) of all rows."""

    values: np.ndarray
    explained: np.ndarray
    projected: DataFrame


def _signs(variants: np.ndarray, width: int) -> np.ndarray:
    """A row of random signs for each variant, the same in every task."""
    z = variants.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((z >> np.uint64(63)).astype(bool), 1.0, -1.0)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(variants, start of each, place of each call, dosage) of runs of whole variants, about CALLS calls long."""
    held, size = [], 0

    def cut(table: pa.Table, last: bool) -> tuple[tuple | None, pa.Table]:
        variant = table.column("variant").to_numpy()
        end = len(variant) if last else int(np.searchsorted(variant, variant[-1]))  # the last variant may go on
        if not end:
            return None, table
        part = table.slice(0, end)
        names, starts = np.unique(part.column("variant").to_numpy(), return_index=True)
        return (names, starts, part.column("ord").to_numpy(), part.column("dosage").to_numpy()), table.slice(end)

    for batch in batches:
        for at in range(0, batch.num_rows, CALLS):
            held.append(batch.slice(at, CALLS))
            size += held[-1].num_rows
            if size >= CALLS:
                found, rest = cut(pa.Table.from_batches(held), False)
                if found:
                    yield found
                held, size = rest.to_batches(), 0
    if held and sum(b.num_rows for b in held):
        yield cut(pa.Table.from_batches(held), True)[0]


def _by_row(parts: DataFrame) -> DataFrame:
    """(ord, values): the sum of the rows of each ord."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for ord_, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = values.values.to_numpy()
                sums[ord_] = sums[ord_] + own if ord_ in sums else own
        if sums:
            yield _rows(np.array(list(sums)), np.array(list(sums.values())))

    return parts.repartition("ord").mapInArrow(merge, "ord int, values array<double>")


def _rows(ords: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(ords) + 1) * values.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ords, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["ord", "values"])


def _pass(dealt: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> DataFrame:
    """(ord, values): what add(total, variants, starts, ords, dosages) sums up over all variants, the rows that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for columns in _columns(batches):
            add(total, *columns)
        met = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(met), 4096):
            part = met[at : at + 4096]
            yield _rows(part, total[part])

    return _by_row(dealt.mapInArrow(run, "ord int, values array<double>"))


def _matrix(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The rows as one matrix of the bounded shape, on the driver."""
    out = np.zeros(shape)
    for r in rows.toLocalIterator():
        out[r["ord"]] = r["values"]
    return out


def _spread(total: np.ndarray, ords: np.ndarray, values: np.ndarray) -> None:
    """total[ords] += values, where ords repeat."""
    order = np.argsort(ords, kind="stable")
    own, starts = np.unique(ords[order], return_index=True)
    if len(own):
        total[own] += np.add.reduceat(values[order], starts)


def truncated_svd(calls: DataFrame, samples: DataFrame, k: int, oversample: int = 10, iterations: int = 5) -> Decomposition:
    """k leading components of calls(sample, variant, dosage), fitted to the samples(sample, train) with train, for all of them.

    A sample and variant have one call at most; a null dosage counts as 0. The matrix is
    not centred. explained is each component's variance over the training samples as a
    share of the variance of all columns. A component is turned so that the training sample
    that lies farthest out on it is on its positive side.
    """
    numbered = stored(row_numbers(samples.select("sample", F.coalesce("train", F.lit(False)).alias("train")), [], [F.when(F.col("train"), 0).otherwise(1), "sample"], "ord"))
    n, m = numbered.count(), numbered.where("train").count()
    width = min(k + oversample, m)
    k = min(k, width)
    if n * width > MAX_CELLS:
        raise ValueError(f"{n} samples by {width} components; {MAX_CELLS} cells are shared at most")
    known = calls.where("dosage <> 0").join(numbered.select("sample", (F.col("ord") - 1).cast("int").alias("ord")), "sample")
    dealt = known.select(F.col("variant").cast("long").alias("variant"), "ord", F.col("dosage").cast("double").alias("dosage"))
    dealt = stored(dealt.repartition("variant").sortWithinPartitions("variant"))
    context = calls.sparkSession.sparkContext

    def onto(basis: np.ndarray, starts: np.ndarray, ords: np.ndarray, dosages: np.ndarray) -> np.ndarray:
        """The variants' rows of A' basis, from the training calls alone."""
        return np.add.reduceat(np.where(ords < m, dosages, 0.0)[:, None] * basis[np.minimum(ords, m - 1)], starts)

    def bring(total: np.ndarray, rows: np.ndarray, starts: np.ndarray, ords: np.ndarray, dosages: np.ndarray) -> None:
        """total += A rows, for the samples that total has."""
        counts = np.diff(np.append(starts, len(ords)))
        mine = ords < len(total)
        _spread(total, ords[mine], dosages[mine, None] * np.repeat(rows, counts, axis=0)[mine])

    def first(total, variants, starts, ords, dosages):
        bring(total, _signs(variants, width), starts, ords, dosages)

    q = np.linalg.qr(_matrix(_pass(dealt, (m, width), first), (m, width)))[0] if m else np.zeros((0, 0))
    for _ in range(iterations if m else 0):
        basis = context.broadcast(q)

        def again(total, variants, starts, ords, dosages):
            bring(total, onto(basis.value, starts, ords, dosages), starts, ords, dosages)

        q = np.linalg.qr(_matrix(_pass(dealt, (m, width), again), (m, width)))[0]
    basis = context.broadcast(q)

    def products(total, variants, starts, ords, dosages):
        rows = onto(basis.value, starts, ords, dosages)
        total += rows.T @ rows

    squares, turn = np.linalg.eigh(_matrix(_pass(dealt, (width, width), products), (width, width)))
    lead = np.argsort(-squares)[:k]
    values = np.sqrt(np.maximum(squares[lead], 0))
    scaled = context.broadcast(q @ (turn[:, lead] / np.maximum(values, 1e-12)))

    def place(total, variants, starts, ords, dosages):
        bring(total, onto(scaled.value, starts, ords, dosages), starts, ords, dosages)

    zero = F.array_repeat(F.lit(0.0), k)
    at = numbered.select("sample", "train", (F.col("ord") - 1).cast("int").alias("ord")).join(_pass(dealt, (n, k), place), "ord", "left")
    found = stored(at.select("sample", "train", F.coalesce("values", zero).alias("values")))
    shape = found.where("train").select(F.posexplode("values").alias("c", "x")).groupBy("c").agg(F.var_pop("x").alias("v"), F.max_by("x", F.abs("x")).alias("far"))
    by_component = {r["c"]: r for r in shape.collect()}  # k rows
    column = dealt.where(F.col("ord") < m).groupBy("variant").agg((F.sum(F.col("dosage") ** 2) / m - F.pow(F.sum("dosage") / m, 2)).alias("v"))
    whole = column.agg(F.sum("v")).first()[0] or 0.0
    explained = np.array([by_component[c]["v"] / whole if whole else 0.0 for c in range(k)])
    signs = F.array(*[F.lit(-1.0 if by_component[c]["far"] < 0 else 1.0) for c in range(k)]) if k else zero
    return Decomposition(values, explained, found.select("sample", "train", F.zip_with("values", signs, lambda a, b: a * b).alias("projection")))
