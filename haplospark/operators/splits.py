"""Split contracts: nested dev parts, splits resolved by id, resumed work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.ranking import row_numbers
from haplospark.operators.sampling import draw_key


def nested_dev(split: DataFrame, id_col: str, part_col: str = "part", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """split with a column dev: of each part the first max(1, round(n * fraction)) rows in drawn order."""
    ranked = row_numbers(split, [part_col], [draw_key(id_col, seed), id_col], "dev_rank", "dev_of")
    return ranked.withColumn("dev", F.col("dev_rank") <= F.greatest(F.lit(1), F.bround(F.col("dev_of") * F.lit(fraction)))).drop("dev_rank", "dev_of")


def resolve(cached: DataFrame, current: DataFrame, id_col: str, require_all: bool = True) -> DataFrame:
    """The cached split's rows with what current knows of their ids. An id that current lacks raises, or is left out."""
    if require_all:
        missing = cached.join(current, id_col, "left_anti").select(id_col).limit(5).collect()
        if missing:
            raise KeyError(f"ids of the cached split that the data set lacks, among them {sorted(r[0] for r in missing)}")
    return cached.join(current, id_col)


def pending(work: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of work whose keys are not done yet; a null key is done if the ledger has a null."""
    done = ledger.select(*[F.col(k).alias(f"done_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"done_{k}")) for k in keys]
    return work.join(done, same, "left_anti")


def over_grid(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """df with each row once for every point of a parameter grid, numbered as grid() does."""
    points = [()]
    for values in axes.values():
        points = [(*p, v) for p in points for v in values]
    rows = [F.struct(F.lit(k).cast("long").alias("point"), *[F.lit(v).alias(name) for name, v in zip(axes, p)]) for k, p in enumerate(points)]
    return df.withColumn("grid_", F.explode(F.array(*rows))).select(*df.columns, "grid_.*")
