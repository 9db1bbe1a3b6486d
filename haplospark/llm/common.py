"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of what an operator broadcasts, in bytes.
BROADCAST_LIMIT = 64 << 20


#: Folders written by this process's sessions, for clean_up().
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and all runs on one machine, as in tests, a folder
    in /tmp is set; on a cluster without the setting this raises.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file:///tmp/checkpoints")
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The folders that materialise() has written and clean_up() not deleted."""
    return set(_WRITTEN)


def clean_up(spark: SparkSession, keep: set[str] = frozenset()) -> int:
    """Delete what materialise() has written, but for keep, once no result that reads it is needed any more; their number."""
    gone = [p for p in _WRITTEN if p not in keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)
    return len(gone)


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow under a fixed schema."""
    return df.mapInArrow(fn, schema)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of the column each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal integer keys, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if held and not np.array_equal(own[:, s], current):
                yield pa.Table.from_batches(held)
                held = []
            current = own[:, s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def input_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names, whatever else df has."""
    return df.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])
