"""Embedding caches: vectors by fingerprint, by window or by sample and window, under the settings that made them.

A cache is a folder with the table vectors and the table settings, a row a setting. What a
reader asks for is checked against the settings when the plan is made, before a row is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layouts by the keys of their vectors, the most specific first.
LAYOUTS = {"sample": ("sample", "window_id"), "fingerprint": ("fp_id",), "window": ("window_id",)}


def layout_of(columns: list[str]) -> str:
    """The layout of a table of vectors with these columns; a table without embedding or known keys raises."""
    if "embedding" in columns:
        for name, keys in LAYOUTS.items():
            if set(keys) <= set(columns):
                return name
    raise ValueError(f"no embedding cache: columns {sorted(columns)}")


def write_cache(vectors: DataFrame, path: str, **settings) -> None:
    """Write vectors(keys of a layout, embedding) with the settings that they depend on, such as half_window, buffer, mode and backend."""
    keys = LAYOUTS[layout_of(vectors.columns)]
    vectors.select(*keys, F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(f"{path}/vectors")
    rows = [(k, repr(v)) for k, v in settings.items()]
    vectors.sparkSession.createDataFrame(rows, "setting string, value string").coalesce(1).write.parquet(f"{path}/settings")


def read_cache(spark: SparkSession, path: str, **expected) -> DataFrame:
    """The vectors of a cache. A setting that it lacks or has otherwise raises, naming all that differ."""
    have = {r["setting"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}  # a row a setting
    if wrong := {k: (have.get(k, "absent"), repr(v)) for k, v in expected.items() if have.get(k) != repr(v)}:
        raise ValueError(f"the cache at {path} was made otherwise: " + ", ".join(f"{k} is {a}, not {b}" for k, (a, b) in sorted(wrong.items())))
    return spark.read.parquet(f"{path}/vectors")


def with_embeddings(windows: DataFrame, vectors: DataFrame, require_all: bool = True) -> DataFrame:
    """windows with the column embedding from a cache of any layout, joined by its keys.

    A key that windows lacks raises; so does, unless require_all is off, a window without a
    vector, when the plan is made.
    """
    keys = list(LAYOUTS[layout_of(vectors.columns)])
    if missing := [k for k in keys if k not in windows.columns]:
        raise ValueError(f"the cache is keyed by {keys}; the windows lack {missing}")
    if require_all and (lost := windows.join(vectors, keys, "left_anti").select(*keys).limit(5).collect()):
        raise ValueError(f"windows without a vector, among them {[tuple(r) for r in lost]}")
    return windows.join(vectors.select(*keys, "embedding"), keys)
