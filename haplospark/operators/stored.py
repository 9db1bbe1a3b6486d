"""Tables that are computed once and read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: computed once, lineage cut, safe from lost executors.

    spark.checkpoint.dir names the folder. Only where it is unset and all runs on one
    machine, as in tests, a folder in /tmp is set; on a cluster without it this raises.
    """
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As stored, in packed columns: for tables with a row for each row of the input."""
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(root or "file:///tmp/checkpoints")
    return context.getCheckpointDir()
