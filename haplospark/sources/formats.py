"""Scans of genomics text formats into long DataFrames. Missing calls are null from the scan on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions.seq import IUPAC

#: Leading columns of a VCF and of a hapmap table that are not samples.
FIXED, HAPMAP_FIXED = 9, 11


def _header(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Fields of the one header line; the scan stops at it."""
    row = spark.read.text(path).where(F.col("value").startswith(prefix)).first()
    if row is None:
        raise ValueError(f"{path} has no line that starts with {prefix}")
    return row["value"].rstrip("\r").split("\t")


def _per_sample(fields: Column, skip: int, names: list[str], wanted: list[int] | None = None) -> Column:
    """array<struct<sample_id, sample_ord, gt>> of a line's fields after the leading ones: one expression, however many samples."""
    calls = F.transform(F.slice(fields, skip + 1, len(names)), lambda x, i: F.struct(F.get(F.lit(names), i).alias("sample_id"), i.alias("sample_ord"), x.alias("gt")))
    if wanted is None or len(wanted) == len(names):
        return calls
    return F.filter(calls, lambda c: F.array_contains(F.lit(wanted), c["sample_ord"]))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos from 0, variant_id, ref, alt) of a VCF or pvar; records without ALT go, the first ALT counts."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        F.regexp_replace(f[0], "(?i)^chr", "").alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[2].alias("name"), f[3].alias("ref"),
        F.substring_index(f[4], ",", 1).alias("alt"),
    )
    fallback = F.concat_ws(":", "chrom", (F.col("pos") + 1).cast("string"))
    return rows.where("alt <> '.'").select("chrom", "pos", F.when(F.col("name") != ".", F.col("name")).otherwise(fallback).alias("variant_id"), "ref", "alt")


def read_calls(spark: SparkSession, path: str, samples: list[str] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """(chrom, pos from 0, ref, alt, sample_id, sample_ord, gt) of a VCF, one row a call; chromosomes are filtered before calls are made."""
    names = _header(spark, path, "#CHROM")[FIXED:]
    if unknown := set(samples or []) - set(names):
        raise KeyError(f"unknown samples: {sorted(unknown)}")
    wanted = [i for i, n in enumerate(names) if samples is None or n in set(samples)]
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        F.regexp_replace(f[0], "(?i)^chr", "").alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f.alias("f")
    )
    rows = rows.where("alt <> '.'")
    if chroms is not None:
        rows = rows.where(F.col("chrom").isin(chroms))
    picks = F.transform(_per_sample(F.col("f"), FIXED, names, wanted), lambda c: c.withField("gt", F.substring_index(c["gt"], ":", 1)))
    return rows.select("chrom", "pos", "ref", "alt", F.explode(picks).alias("c")).select(
        "chrom", "pos", "ref", "alt", "c.sample_id", "c.sample_ord", F.when(~F.col("c.gt").rlike(r"^\.([/|]\.)?$"), F.col("c.gt")).alias("gt")
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """IIDs of a psam in file order, numbered from 0; ids stay strings. Lines are counted by split, and only a row a split is summed up."""
    names = [n.lstrip("#") for n in _header(spark, path, "#")]
    field = F.split("value", "\t")[names.index("IID")]
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    keyed = lines.select(field.alias("iid"), F.monotonically_increasing_id().alias("line")).withColumn("split", F.shiftright("line", 33))
    sizes = keyed.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("split", F.coalesce(F.sum("n").over(W.orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("split").orderBy("line")) - 1
    return keyed.join(F.broadcast(starts), "split").select("iid", (F.col("start") + rank).cast("long").alias("sample_ord"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, seq in upper case) of each record; the file is split at '>' by the reader, not on the driver."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return records.select(name.alias("name"), F.length(seq).alias("length"), seq.alias("seq"))


def read_gff(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """(chrom, kind, start from 0, end, strand, id) of a GFF3; [start, end) from 1-based inclusive."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("\t")).select(
        F.regexp_replace(f[0], "(?i)^chr", "").alias("chrom"), f[2].alias("kind"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"),
        f[6].alias("strand"), F.regexp_extract(f[8], r"(?:^|;)ID=([^;]+)", 1).alias("id"),
    )
    return rows.where(F.col("kind").isin(kinds)) if kinds else rows


def read_allc(spark: SparkSession, path: str) -> DataFrame:
    """(accession, chrom, pos, strand, context, mc, total) of allc tables; the accession is the file's name."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.tsv|\.txt)?(\.gz)?$", 1).alias("accession"), F.regexp_replace(F.upper(f[0]), "^CHR", "").alias("chrom"),
        F.expr("try_cast(split(value, '\t')[1] as long)").alias("pos"), f[2].alias("strand"), f[3].alias("context"),
        F.expr("try_cast(split(value, '\t')[4] as int)").alias("mc"), F.expr("try_cast(split(value, '\t')[5] as int)").alias("total"),
    )
    return rows.where("pos is not null and chrom rlike '^[1-5]$'")


def read_hapmap(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos from 0, variant_id, ref, alt, sample_id, sample_ord, gt) of a hapmap table, one row a call.

    The first of the two alleles is the reference; a base that is neither allele, nor
    the het code of both, is a missing call. Records whose alleles are not two different
    bases of A, C, G and T go.
    """
    names = _header(spark, path, "rs#")[HAPMAP_FIXED:]
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("rs#") & (F.col("value") != "")).select(
        F.regexp_replace(f[2], "(?i)^chr", "").alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[0].alias("variant_id"),
        F.split_part(f[1], F.lit("/"), F.lit(1)).alias("ref"), F.split_part(f[1], F.lit("/"), F.lit(2)).alias("alt"), f.alias("f"),
    )
    rows = rows.where("ref <> alt and ref in ('A', 'C', 'G', 'T') and alt in ('A', 'C', 'G', 'T')")
    calls = rows.select("chrom", "pos", "variant_id", "ref", "alt", F.explode(_per_sample(F.col("f"), HAPMAP_FIXED, names)).alias("c"))
    calls = calls.select("chrom", "pos", "variant_id", "ref", "alt", "c.sample_id", "c.sample_ord", F.upper(F.trim("c.gt")).alias("base"))
    codes = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    both = F.try_element_at(codes, F.col("base"))
    het = (both == F.concat_ws("/", "ref", "alt")) | (both == F.concat_ws("/", "alt", "ref"))
    gt = F.when(F.col("base") == F.col("ref"), "0/0").when(F.col("base") == F.col("alt"), "1/1").when(het, "0/1")
    return calls.withColumn("gt", gt).drop("base")


def read_soft(spark: SparkSession, path: str) -> DataFrame:
    """(kind, accession, key, value) of a SOFT file, one row an attribute; the reader cuts the records at a caret that starts a line."""
    records = spark.read.option("lineSep", "\n^").text(path)
    head = F.regexp_replace("value", r"^\^", "")
    rows = records.select(
        F.regexp_extract(head, r"^(\w+) = ", 1).alias("kind"), F.regexp_extract(head, r"^\w+ = (\S+)", 1).alias("accession"),
        F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^!(\S+ = .*)$"), F.lit(1))).alias("line"),
    )
    pair = F.split("line", " = ", 2)
    return rows.where("kind <> ''").select("kind", "accession", pair[0].alias("key"), F.trim(pair[1]).alias("value"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL ledger; a half-written line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_vcf(calls: DataFrame, path: str, samples: list[str]) -> None:
    """calls(chrom, pos from 0, variant_id, ref, alt, sample_id, gt) as sorted VCF text parts; the header leads the first."""
    head = "\n".join(["##fileformat=VCFv4.2", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + samples)])
    one_each = calls.groupBy("chrom", "pos", "variant_id", "ref", "alt", "sample_id").agg(F.max("gt").alias("gt"))
    by_ord = one_each.join(F.broadcast(calls.sparkSession.createDataFrame(list(enumerate(samples)), "ord int, sample_id string")), "sample_id")
    cells = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("gt", F.lit("./.")).alias("gt"))))
    wide = by_ord.groupBy("chrom", "pos", "variant_id", "ref", "alt").agg(cells.alias("cells"))
    # between two samples that have a call stand as many missing ones as their numbers lie apart
    ends = F.transform("cells", lambda c, i: F.struct((c["ord"] - F.when(i > 0, F.get("cells", i - 1)["ord"]).otherwise(-1) - 1).alias("gap"), c["gt"].alias("gt")))
    filled = F.flatten(F.transform(ends, lambda c: F.concat(F.array_repeat(F.lit("./."), c["gap"]), F.array(c["gt"]))))
    tail = F.array_repeat(F.lit("./."), F.lit(len(samples)) - 1 - F.element_at("cells", -1)["ord"])
    wide = wide.select("chrom", "pos", "variant_id", "ref", "alt", F.array_join(F.concat(filled, tail), "\t").alias("g"))
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), "variant_id", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "g")
    rows = wide.select(F.lit(1).alias("body"), "chrom", "pos", line.alias("value"))
    first = calls.sparkSession.createDataFrame([(0, None, None, head)], rows.schema)
    rows.unionByName(first).repartitionByRange("body", "chrom", "pos").sortWithinPartitions("body", "chrom", "pos").select("value").write.text(path)


def read_dart(spark: SparkSession, path: str, meta: int) -> DataFrame:
    """(allele_id, clone_id, seq, snp, snp_pos, sample_id, call) of an unpacked DArTSeq report, one row a call.

    The report's first line names the sample of each column after the meta leading ones;
    a column counts if its name is all digits and stands for the first time. Lines above
    the line of column names have no base sequence and go with all others that lack one.
    """
    first = spark.read.text(path).first()
    names = [n.strip() for n in first["value"].rstrip("\r").split(",")] if first else []
    columns: dict[str, int] = {}
    for i, name in enumerate(names[meta:], meta):
        if name.isascii() and name.isdigit():
            columns.setdefault(name, i)
    f = F.split(F.regexp_replace("value", "\r$", ""), ",", -1)
    rows = spark.read.text(path).select(f.alias("f")).where("get(f, 2) rlike '^[ACGTNacgtn]+$'")
    kept = F.arrays_zip(F.lit(list(columns) or [""]).alias("sample_id"), F.lit(list(columns.values()) or [-1]).alias("at"))
    calls = F.transform(F.filter(kept, lambda c: c["at"] >= 0), lambda c: F.struct(c["sample_id"].alias("sample_id"), F.get("f", c["at"]).alias("call")))
    fields = ("allele_id", "clone_id", "seq", "snp", "snp_pos")
    flat = rows.select(*[F.get("f", F.lit(i)).alias(k) for i, k in enumerate(fields)], F.explode(calls).alias("c"))
    known = F.when(F.trim("c.call").rlike("^[0-9]+$"), F.trim("c.call"))
    return flat.select(*fields[:4], F.expr("try_cast(snp_pos as int)").alias("snp_pos"), "c.sample_id", known.alias("call"))


def remap_calls(calls: DataFrame, coordinates: DataFrame, drop_unmapped: bool = True) -> DataFrame:
    """calls under the positions of coordinates(chrom, pos, new_pos); what has none goes, or keeps its own."""
    out = calls.join(coordinates, ["chrom", "pos"], "inner" if drop_unmapped else "left")
    return out.withColumn("pos", F.coalesce("new_pos", "pos")).drop("new_pos")
