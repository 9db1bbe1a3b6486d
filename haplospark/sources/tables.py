"""Scans and writers of phenotype tables, matrices and run records."""

from __future__ import annotations

import time
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.functions.seq import chrom_number


def _number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def read_phenotypes(spark: SparkSession, path: str, id_col: str, sep: str = ",", traits: list[str] | None = None) -> DataFrame:
    """(iid, trait, value) of a wide table, read as strings; what is no number is null, and ids stay strings."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    names = [c for c in wide.columns if c != id_col and (traits is None or c in traits)]
    if not names:
        return wide.select(F.col(f"`{id_col}`").alias("iid"), F.lit(None).cast("string").alias("trait"), F.lit(None).cast("double").alias("value")).where("false")
    cells = wide.select(F.col(f"`{id_col}`").alias("iid"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("at", "cell"))
    return cells.select("iid", F.get(F.lit(names), F.col("at")).alias("trait"), _number(F.col("cell")).alias("value"))


def read_by_file(spark: SparkSession, glob: str, pattern: str, sep: str = ",") -> DataFrame:
    """All tables that match glob, with file_id: the pattern's first group in the file's name. A file whose name does not match goes."""
    rows = spark.read.option("header", True).option("sep", sep).csv(glob)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return rows.withColumn("file_id", F.regexp_extract(name, pattern, 1)).where("file_id <> ''")


def read_matrix(spark: SparkSession, path: str, token: str = r"^(.*)$") -> DataFrame:
    """(row_id, sample, value) of a matrix with blanks between its cells; the first line names the samples, by the token's first group."""
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = head["value"].split()
    lines = spark.read.text(path).where((F.col("value") != head["value"]) & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    row = lines.select(f[0].alias("row_id"), F.slice(f, 2, 1 << 30).alias("cells"))
    first = F.lit(len(names)) - F.size("cells")  # the header may name the id column too
    cells = row.select("row_id", F.posexplode("cells").alias("i", "cell"), first.alias("first"))
    name = F.regexp_extract(F.get(F.lit(names), F.col("i") + F.greatest("first", F.lit(0))), token, 1)
    return cells.select("row_id", name.alias("sample"), _number(F.col("cell")).alias("value"))


def read_bare_matrix(spark: SparkSession, path: str, row_ids: list[str], column_ids: list[str], sep: str = "\t") -> DataFrame:
    """(row_id, column_id, value) of a matrix without names; one whose lines are as long as row_ids, and not as column_ids, is turned."""
    lines = spark.read.text(path).select(F.split("value", sep).alias("cells"), F.monotonically_increasing_id().alias("line"))
    splits = lines.groupBy(F.shiftright("line", 33).alias("split")).agg(F.count(F.lit(1)).alias("n")).orderBy("split").collect()  # a row a split
    width, total = lines.select(F.size("cells")).first()[0], sum(r["n"] for r in splits)
    turned = width != len(column_ids) and width == len(row_ids)
    if (width, total) != ((len(row_ids), len(column_ids)) if turned else (len(column_ids), len(row_ids))):
        raise ValueError(f"a matrix of {total} x {width} for {len(row_ids)} rows and {len(column_ids)} columns")
    before, starts = 0, {}
    for r in splits:
        starts[r["split"]] = before
        before += r["n"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.shiftright("line", 33))
    at = (start + F.col("line").bitwiseAND((1 << 33) - 1)).cast("int")
    cells = lines.select(at.alias("at"), F.posexplode("cells").alias("i", "cell"))
    r, c = (F.col("i"), F.col("at")) if turned else (F.col("at"), F.col("i"))
    return cells.select(F.get(F.lit(row_ids), r).alias("row_id"), F.get(F.lit(column_ids), c).alias("column_id"), _number(F.col("cell")).alias("value"))


def read_elements(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(name, chrom, start, end) of a list of transposable elements; the chromosome is the digit in names such as AT1TE00010."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    f = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(f[0].alias("name"), F.regexp_extract(f[0], r"AT(\d)TE", 1).try_cast("int").alias("chrom"), f[2].try_cast("long").alias("start"), f[3].try_cast("long").alias("end"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, text_2, label) of a table with a heading and two columns (text, label) or three (text, text_2, label)."""
    rows = spark.read.option("header", True).csv(path)
    f = [F.col(f"`{c}`") for c in rows.columns]
    if len(f) not in (2, 3):
        raise ValueError(f"{path} has {len(f)} columns")
    second = f[1] if len(f) == 3 else F.lit(None).cast("string")
    return rows.select(f[0].alias("text"), second.alias("text_2"), f[-1].try_cast("int").alias("label"))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A table with a heading as CSV parts."""
    df.write.option("header", True).option("sep", sep).mode("errorifexists").csv(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet in a folder for each value of the keys, such as chrom, or dataset, features and model of a run."""
    df.write.partitionBy(*keys).mode("append").parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines log; what is there stays."""
    rows.write.mode("append").json(path)


def flattened(record: dict, prefix: str = "") -> dict[str, str]:
    """A nested run record as one row of texts, its keys joined by dots."""
    out = {}
    for key, value in record.items():
        if isinstance(value, dict):
            out |= flattened(value, f"{prefix}{key}.")
        else:
            out[f"{prefix}{key}"] = "" if value is None else str(value)
    return out


#: A row of a manifest; written has nanoseconds, or null in older manifests.
MANIFEST = "run_id string, key string, value string, written long"


def append_run(spark: SparkSession, record: dict, path: str) -> None:
    """Add a run record to a manifest of (run_id, key, value); a record without run_id is refused."""
    run_id = record["run_id"]
    now = time.time_ns()
    rows = [(str(run_id), k, v, now) for k, v in flattened(record).items()]
    spark.createDataFrame(rows, MANIFEST).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, values map<string, string>) of a manifest; of a key that was written again the last value counts."""
    rows = spark.read.schema(MANIFEST).json(path)
    last = rows.groupBy("run_id", "key").agg(F.max_by("value", F.struct(F.coalesce("written", F.lit(0)), "value")).alias("value"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
