"""The corpus pipeline: language ID, near-dedup, passage dedup, source mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.llm import bpe, langid, mixing, simhash, suffix
from haplospark.llm.common import clean_up, materialise, written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names of our own, which clash with nothing, and those names by column."""
    own = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter in it) go."""
    sample = langid.fit_sample(docs.where(~langid.held_out()))
    rows, own = _plain(docs)
    found = langid.identify(rows, sample, own["doc_id"], own["text"], keep=[c for k, c in own.items() if k != "doc_id"])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*own.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row stays: the smallest id, nulls last, then the smallest hash of the row.

    Rows are told apart by a number of their own, so null, repeated and shared ids do no
    harm; only among rows equal in all columns does the number decide.
    """
    rows, own = _plain(docs)
    tagged = materialise(rows.withColumn("row_", F.monotonically_increasing_id()))
    doc_id = F.col(own["doc_id"])
    key = F.struct(doc_id.isNull().alias("unknown"), doc_id.alias("id"), F.xxhash64(*own.values()).alias("hash"), F.col("row_").alias("row"))
    groups = simhash.near_duplicates(tagged.withColumn("key_", key), shingle=4, max_distance=4, id_col="key_", text_col=own["text"])
    gone = groups.where("component_id.row <> key_.row").select(F.col("key_.row").alias("row_"))
    return tagged.join(gone, "row_", "left_anti").select(*own.values()).toDF(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier go; n_chars follows the text."""
    rows, own = _plain(docs)
    rest = [c for k, c in own.items() if k not in ("doc_id", "text")]
    left = suffix.remove_repeats(rows, 100, own["doc_id"], own["text"], keep=rest, with_text=True, block_bytes=1 << 20)
    left = left.withColumn(own["n_chars"], F.length(own["text"]).cast("long"))
    return left.select(*own.values()).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes once for each pass that takes it whole, and once with its first words where a pass ends in it.

    Rows are known by hashes of id, source and text, so null and repeated ids are told
    apart; rows equal in all three are interchangeable, and only their count matters.
    """
    keys = [F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("k2")]
    taken = mixing.mix(docs.select(F.struct(*keys).alias("key"), "source", "text"), id_col="key").where("taken > 0")
    whole = F.array_repeat(F.lit(0).cast("long"), F.col("passes").cast("int"))
    copies = F.concat(whole, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    slots = taken.select("key.k1", "key.k2", F.explode(copies).alias("first_words"))
    one_of_equals = F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))
    _, own = _plain(docs)
    known = docs.select(*[F.col(f"`{k}`").alias(c) for k, c in own.items()], *keys).withColumn("n", one_of_equals).where("n = 1")
    words = F.regexp_extract_all(own["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("first_words").cast("int")), "")
    text = F.when(F.col("first_words") > 0, cut).otherwise(F.col(own["text"]))
    out = known.join(slots, ["k1", "k2"]).withColumn(own["text"], text)
    out = out.withColumn(own["n_chars"], F.length(own["text"]).cast("long"))
    return out.select(*own.values()).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as counts and digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, memory_entries=100_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: SQL cannot express the language model, the groups or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; of what they write only the last stage's input is left."""
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        staged = stage(spark, docs, sf_dir)
        own = written()
        docs = materialise(staged)
        clean_up(spark, keep=others | (written() - own))
    return STAGES[-1][1](spark, docs, sf_dir)
