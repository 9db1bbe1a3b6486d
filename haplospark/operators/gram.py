"""Dosage rows of variants, and Gram matrices over samples summed in tiles.

A variant is a row with a byte for each sample, in a fixed order, so joins and shuffles
move one byte a call. Samples have parts (0: train); rows are standardised within each
part by its own mean and deviation, a missing call standing at the mean of all samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.kernel import check_samples

#: Samples along one side of a tile.
TILE = 512
#: Variants that are standardised at once.
ROWS = 2048


def dosage_rows(calls: DataFrame, ids: list, impute: str = "ref") -> DataFrame:
    """(variant, dosages binary) of calls(sample, variant, dosage): a signed byte for each of ids, -1 where the call is missing.

    A call without a row is dosage 0 (ref) or missing (mean); a row with a null dosage is missing.
    """
    if impute not in ("ref", "mean"):
        raise ValueError(f"no imputation {impute}")
    check_samples(len(ids))
    kind = dict(calls.dtypes)["sample"]
    order = calls.sparkSession.createDataFrame([(x, n) for n, x in enumerate(ids)], f"sample {kind}, ord int")
    cell = F.struct("ord", F.coalesce(F.col("dosage").cast("byte"), F.lit(-1).cast("byte")).alias("d"))
    cells = calls.join(F.broadcast(order), "sample").groupBy("variant").agg(F.collect_list(cell).alias("c"))  # a row a sample
    flat = cells.select("variant", F.col("c.ord").alias("at"), F.col("c.d").alias("d"))
    blank, n = (0 if impute == "ref" else -1), len(ids)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, d in zip(batch.column(1), batch.column(2)):
                row = np.full(n, blank, np.int8)
                row[at.values.to_numpy()] = d.values.to_numpy()
                rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["variant", "dosages"])

    return flat.mapInArrow(fill, f"variant {dict(calls.dtypes)['variant']}, dosages binary")


def unpack(column: pa.Array, n: int) -> np.ndarray:
    """The dosage rows of a binary column, a row a variant."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, n)


def standardise(rows: np.ndarray, parts: np.ndarray, maf_min: float = 0.0) -> np.ndarray:
    """The rows whose minor allele frequency is maf_min or more, each part at mean 0 and deviation 1 (a constant part at 0)."""
    there = rows >= 0
    mean = np.where(there, rows, 0).sum(1) / np.maximum(there.sum(1), 1)
    keep = (np.minimum(mean, 2 - mean) / 2 >= maf_min) & there.any(1)
    z = np.where(there, rows, mean[:, None])[keep]
    for part in np.unique(parts):
        own = parts == part
        z[:, own] -= z[:, own].mean(1, keepdims=True)
        spread = np.sqrt((z[:, own] ** 2).mean(1, keepdims=True))
        z[:, own] /= np.where(spread > 1e-9, spread, 1.0)
    return z


def kinship(rows: DataFrame, parts: np.ndarray, maf_min: float = 0.0) -> np.ndarray:
    """Z Z' / p over all p variants of dosage rows that have the frequency, for MAX_SAMPLES samples at most.

    Every task adds up its variants and hands on a row for each tile; the tiles are summed
    in Spark, and only the sums, whose size check_samples bounds, reach the driver.
    """
    n = len(parts)
    check_samples(n)
    edges = list(range(0, n, TILE)) + [n]
    tiles = [(i, j) for i in range(len(edges) - 1) for j in range(i + 1)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, p = np.zeros((n, n)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = standardise(unpack(batch.column(0).slice(at, ROWS), n), parts, maf_min)
                total += z.T @ z
                p += len(z)
        if p:
            cells = [total[edges[i] : edges[i + 1], edges[j] : edges[j + 1]].tobytes() for i, j in tiles]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tiles)), pa.int32()), pa.array([p] * len(tiles), pa.int64()), pa.array(cells, pa.binary())], ["tile", "p", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for tile, p, cells in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(tile, [0, 0.0])
                own[0] += p
                own[1] = own[1] + np.frombuffer(cells)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums.keys(), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())],
                ["tile", "p", "cells"],
            )

    schema = "tile int, p long, cells binary"
    summed = rows.select("dosages").mapInArrow(add, schema).repartition("tile").mapInArrow(merge, schema)
    out, p = np.zeros((n, n)), 0
    for row in summed.collect():  # the tiles of one bounded matrix
        i, j = tiles[row["tile"]]
        cells = np.frombuffer(row["cells"]).reshape(edges[i + 1] - edges[i], -1)
        out[edges[i] : edges[i + 1], edges[j] : edges[j + 1]] = cells
        out[edges[j] : edges[j + 1], edges[i] : edges[i + 1]] = cells.T
        p = row["p"]
    return out / max(p, 1)
