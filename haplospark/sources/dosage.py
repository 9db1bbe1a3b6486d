"""Dosages of many samples in packed rows, read by range of positions.

A variant is a row of two bits a sample (3: missing), and rows lie in folders by chromosome
and block of positions. A range is a partition filter and a position filter on the scan, so
other blocks are never opened; a choice of samples is cut out of the packed row in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 20
#: Dosage rows that are packed or unpacked at once.
ROWS = 1024


def pack(rows: np.ndarray) -> np.ndarray:
    """Signed dosages (-1: missing), a row a variant, as two bits each, the first sample in the lowest bits."""
    codes = np.where(rows < 0, 3, rows).astype(np.uint8)
    padded = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4))).reshape(len(codes), -1, 4)
    return (padded << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)


def unpack(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The signed dosages at the places of packed rows."""
    codes = (packed[:, places >> 2] >> ((places & 3) * 2).astype(np.uint8)) & 3
    return np.where(codes == 3, -1, codes).astype(np.int8)


def _mapped(df: DataFrame, column: str, fn) -> DataFrame:
    """df with fn applied to its binary column of equally long rows."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                raw = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                rows = pa.array([row.tobytes() for row in fn(raw)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def write_dosages(rows: DataFrame, ids: list, path: str, block: int = BLOCK) -> None:
    """Write rows(variant, chrom, pos, dosages), as gram.dosage_rows gives them for the samples ids."""
    kept = rows.select("variant", "chrom", F.col("pos").cast("long").alias("pos"), "dosages", F.floor(F.col("pos") / block).alias("block"))
    packed = _mapped(kept, "dosages", lambda raw: pack(raw.view(np.int8)))
    packed.repartition("chrom", "block").sortWithinPartitions("chrom", "block", "pos").write.partitionBy("chrom", "block").parquet(f"{path}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(str(x), n, block) for n, x in enumerate(ids)], "sample string, ord int, bases long").coalesce(1).write.parquet(f"{path}/samples")


def read_dosages(spark: SparkSession, path: str, chrom, start: int | None = None, end: int | None = None, samples: list | None = None) -> DataFrame:
    """(variant, chrom, pos, dosages) with start <= pos < end on a chromosome, a signed byte for each of samples (default: all) in their order.

    A sample that the table lacks raises when the plan is made.
    """
    known = {r["sample"]: (r["ord"], r["bases"]) for r in spark.read.parquet(f"{path}/samples").collect()}  # a row a sample
    names = sorted(known, key=lambda x: known[x][0]) if samples is None else [str(x) for x in samples]
    if unknown := [x for x in names if x not in known]:
        raise ValueError(f"unknown samples {unknown[:5]}")
    places = np.array([known[x][0] for x in names], np.int64)
    block = next(iter(known.values()))[1] if known else BLOCK
    rows = spark.read.parquet(f"{path}/rows").where(F.col("chrom") == chrom)
    if start is not None:
        rows = rows.where((F.col("block") >= start // block) & (F.col("pos") >= start))
    if end is not None:
        rows = rows.where((F.col("block") <= (end - 1) // block) & (F.col("pos") < end))
    return _mapped(rows.select("variant", "chrom", "pos", "dosages"), "dosages", lambda raw: unpack(raw, places))
