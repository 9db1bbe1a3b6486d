"""Plan-time choices of rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **criteria) -> DataFrame:
    """Rows whose columns equal the given values; a list means any of them, None leaves the column free."""
    for name, want in criteria.items():
        if want is not None:
            df = df.where(F.col(name).isin(list(want) if isinstance(want, (list, tuple, set)) else [want]))
    return df


def resolve(df: DataFrame, names: list[str] | None, not_traits: tuple[str, ...] = ()) -> list[str]:
    """The named columns, or all but not_traits; an unknown name is an error before anything runs."""
    known = [c for c in df.columns if c not in not_traits]
    if names is None:
        return known
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown traits {unknown}; there are {known}")
    return list(names)
