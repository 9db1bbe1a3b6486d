"""Reference sequences as rows of fixed chunks, and windows cut out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions.seq import chrom_number, patch

CHUNK = 1 << 16


def with_offsets(lengths: DataFrame) -> DataFrame:
    """(chrom, length) with start: the lengths of the chromosomes before it. One row a chromosome."""
    ahead = W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)
    return lengths.withColumn("start", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length, start) of the integer-named chromosomes of a FASTA index."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(chrom_number(f[0]).alias("chrom"), f[1].cast("long").alias("length"))
    return with_offsets(rows.where("chrom is not null"))


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_no, seq in upper case) of a FASTA file's integer-named chromosomes, chunk bases a row.

    The file is read line by line: a header line opens a chromosome, and each line of bases
    is placed by the number of bases before it in its chromosome, summed within and over
    the file's splits. So no chromosome is ever one value.
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select("split", "line", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)).alias("head"), F.upper(F.regexp_replace("value", r"\s", "")).alias("seq"))
    lines = lines.withColumn("n", F.when(F.col("head").isNull(), F.length("seq")).otherwise(0).cast("long"))
    own = W.partitionBy("split").orderBy("line")
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    # within a split: the chromosome's name where the split has it, and the bases since its head (or since the split began)
    placed = lines.withColumns({"name": F.last("head", True).over(so_far), "upto": F.sum("n").over(so_far)})
    base = F.coalesce(F.max(F.when(F.col("head").isNotNull(), F.col("upto"))).over(so_far), F.lit(0))
    placed = placed.withColumn("at", F.col("upto") - F.col("n") - base)
    # over the splits: what the last chromosome of the one before hands on, one row a split
    ends = placed.groupBy("split").agg(F.max_by("name", "line").alias("name"), F.max_by(F.col("at") + F.col("n"), "line").alias("bases"))
    order = W.orderBy("split")
    opened = F.count("name").over(order.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("split", F.last("name", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"), "name", "bases", opened.alias("opened"))
    group = W.partitionBy("opened").orderBy("split")
    carried = F.sum("bases").over(group.rowsBetween(W.unboundedPreceding, -1))
    last = F.lag("bases").over(order)
    # splits with the same number of opened names: the first follows the split that opened the name, the others have no head before them
    first = F.row_number().over(group) == 1
    opener = F.when(first, F.coalesce(last, F.lit(0)))
    ends = ends.withColumns({"opener": opener, "more": F.coalesce(carried, F.lit(0))})
    ends = ends.withColumn("shift", F.max("opener").over(W.partitionBy("opened")) + F.col("more"))
    joined = placed.where("n > 0").join(F.broadcast(ends.select("split", "before", "shift")), "split")
    chrom = chrom_number(F.coalesce("name", "before"))
    start = F.col("at") + F.when(F.col("name").isNull(), F.col("shift")).otherwise(0)
    bases = joined.select(chrom.alias("chrom"), start.alias("start"), "n", "seq").where("chrom is not null")
    # a line is cut at the edges of chunks, and a chunk's pieces are put together in order
    bases = bases.select("chrom", "start", "n", "seq", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("n") - 1) / chunk))).alias("chunk_no"))
    low = F.greatest("start", F.col("chunk_no") * chunk)
    high = F.least(F.col("start") + F.col("n"), (F.col("chunk_no") + 1) * chunk)
    piece = F.struct(low.alias("low"), F.substr("seq", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    parts = bases.groupBy("chrom", "chunk_no").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    return parts.select("chrom", "chunk_no", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))


def fetch_windows(chunks: DataFrame, windows: DataFrame, alts: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """windows(chrom, start from 0, width and others) with seq: the reference there, N beyond its ends.

    A window meets the chunks that it lies in, by an equality join. alts, an
    array<struct<at, base>> of windows with at from the window's start, is laid over it.
    """
    first = F.floor(F.greatest(F.col("start"), F.lit(0)) / chunk)
    last = F.floor(F.greatest(F.col("start") + F.col("width") - 1, F.lit(0)) / chunk)
    keyed = windows.withColumn("window_no", F.monotonically_increasing_id())
    spread = keyed.select("window_no", "chrom", "start", "width", F.explode(F.sequence(first, last)).alias("chunk_no"))
    low = F.greatest(F.col("start") - F.col("chunk_no") * chunk, F.lit(0))
    high = F.least(F.col("start") + F.col("width") - F.col("chunk_no") * chunk, F.length("seq"))
    piece = F.substr("seq", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    cut = spread.join(chunks, ["chrom", "chunk_no"]).groupBy("window_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("piece")))).alias("parts"))
    inside = F.coalesce(F.array_join(F.transform("parts", lambda p: p["piece"]), ""), F.lit(""))
    left = F.array_join(F.array_repeat(F.lit("N"), F.greatest(F.lit(0), F.least(-F.col("start"), F.col("width"))).cast("int")), "")
    seq = F.rpad(F.concat(left, inside), F.col("width").cast("int"), "N")
    out = keyed.join(cut, "window_no", "left").withColumn("seq", seq)
    if alts is not None:
        out = out.withColumn("seq", patch(F.col("seq"), alts))
    return out.drop("window_no", "parts")
