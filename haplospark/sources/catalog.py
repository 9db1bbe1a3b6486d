"""Named data sets: each name stands for a path stem, and its tables become views."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from haplospark.sources import formats


def existing(spark: SparkSession, stem: str, endings: tuple[str, ...] = (".vcf", ".vcf.gz")) -> str:
    """The first of stem's endings that Spark can open; with none, the error names the first."""
    for ending in endings:
        try:
            spark.read.text(stem + ending)
        except AnalysisException:
            continue
        return stem + ending
    raise FileNotFoundError(stem + endings[0])


def register(spark: SparkSession, stems: dict[str, str], name: str, aliases: dict[str, str] | None = None) -> list[str]:
    """Temporary views <name>_variants and <name>_calls of a named data set; an alias stands for the name it points to."""
    target = (aliases or {}).get(name, name)
    if target not in stems:
        raise KeyError(f"unknown data set {name}; there are {sorted(stems)}")
    path = existing(spark, stems[target])
    views = {f"{name}_variants": formats.read_variants(spark, path), f"{name}_calls": formats.read_calls(spark, path)}
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    return list(views)
