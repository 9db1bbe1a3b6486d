"""Fill-in-the-middle: each text is cut in three and its middle moved to the end.

An Arrow-batched pandas UDF walks a text with the regex library: finditer gives the end
offset of each unit, kept in a compact array, and the two cuts are two lookups in it.
hashlib gives the seed that chooses cuts and form, and the digests. A row depends on
nothing but its id and text, so the plan has no shuffle and a lost task is run again alone.

Defined cases: a null text counts as empty; a null id seeds as an empty string; an empty
text, and one that holds a sentinel already, stays plain, as it could not be taken apart
again; repeated rows give repeated results, and rows that share an id share its seed;
equal cuts give an empty middle; an empty table gives no rows; other columns of the
input are ignored, whatever their names; very long texts are cut whole, with four bytes
of offset for each unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import input_columns

#: Marks of prefix, suffix and middle in the output.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit of one code point.
CODE_POINT = r"(?s:.)"
_END = type(regex.match("", "")).end
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def draws(seed: str) -> tuple[int, int, int, int]:
    """The four numbers of a seed: the first four groups of eight digits of its SHA-256."""
    digest = hashlib.sha256(seed.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The end offset of each unit, left to right."""
    return array("I", map(_END, unit.finditer(text, concurrent=False)))  # kept by one thread: no lock changes hands for each unit


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    p, s, m = sentinels
    if form == "psm":
        prefix, _, rest = output.removeprefix(p).partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = output.removeprefix(s).partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def transform(
    text: str, seed: str, unit: regex.Pattern, percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, prefix's and middle's code points) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed)
    if not text or h3 % 100 >= percent or any(mark in text for mark in sentinels):
        return text, "plain", n, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return "".join((s, suffix, p, prefix, m, middle)), "spm", n, a, b - a
    return "".join((p, prefix, s, suffix, m, middle)), "psm", n, a, b - a


def fill_in_middle(
    df: DataFrame, unit: str = CODE_POINT, percent: int = 90, spm_percent: int = 20, version: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False,
) -> DataFrame:
    """The id column, n (units), form (plain, psm or spm), prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it.

    unit is a pattern of the regex library; what it leaves out before a unit goes with that
    unit, and what follows the last one belongs to the suffix. percent of the texts are
    transformed, spm_percent of those with the suffix first. A sentinel must not be part of
    another, nor end as one begins. with_output adds the output text.
    """
    if any(a in b for a in sentinels for b in sentinels if a is not b) or any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, len(a))):
        raise ValueError("sentinels overlap")
    rows = input_columns(df, id=id_col, text=text_col)

    @F.pandas_udf(SCHEMA + ", output string" * with_output)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(unit)
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["output"] * with_output
        for seeds, texts in batches:
            out = []
            for seed, text in zip(seeds, texts):
                text = text or ""
                output, form, n, prefix, middle = transform(text, seed, units, percent, spm_percent, sentinels)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, restore(output, form, sentinels))]
                out.append((n, form, prefix, middle, *digests, output)[: len(names)])
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    seed = F.concat(F.lit(f"{version}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return rows.select("id", run(seed, "text").alias("out_")).select(F.col("id").alias(id_col), "out_.*")
