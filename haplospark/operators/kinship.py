"""Relationship matrices, summed from blocks of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.sampling import numbered

#: Products of calls that a task holds at once, and calls.
PRODUCTS, CALLS = 1 << 22, 1 << 20
#: Samples whose pairs a task may sum as a matrix.
MAX_DENSE = 2048


def standardised(calls: DataFrame, n_samples: DataFrame) -> DataFrame:
    """(sample, variant, z) of calls(sample, variant, dosage), a missing call standing at its variant's mean.

    n_samples has one row with the number n of samples. The deviation counts the filled
    cells, so a variant's filled cells have z 0 and need no row; constant variants go.
    """
    d = F.col("dosage").cast("double")
    moments = calls.groupBy("variant").agg(F.avg(d).alias("m"), (F.sum(d * d) - F.sum(d) * F.avg(d)).alias("ss"))
    moments = moments.join(F.broadcast(n_samples)).select("variant", "m", F.sqrt(F.greatest("ss", F.lit(0.0)) / F.col("n")).alias("s")).where("s > 1e-9")
    return calls.join(moments, "variant").select("sample", "variant", ((d - F.col("m")) / F.col("s")).alias("z"))


def _pair_sums(sample: np.ndarray, variant: np.ndarray, z: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, k) with i <= j, in pieces: sums of products over the variants of calls that are sorted by variant."""
    own, code = np.unique(sample, return_inverse=True)
    order = np.lexsort((code, variant))
    code, variant, z = code[order], variant[order], z[order]
    starts = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
    sizes = np.diff(np.append(starts, len(variant)))
    if len(own) <= MAX_DENSE and len(z) > len(own) * len(starts) / 4:  # most samples are called
        for at in range(0, len(starts), max(1, limit // len(own))):
            block = slice(starts[at], np.append(starts, len(z))[min(at + max(1, limit // len(own)), len(starts))])
            dense = np.zeros((len(own), min(max(1, limit // len(own)), len(starts) - at)))
            np.add.at(dense, (code[block], np.repeat(np.arange(len(sizes)), sizes)[block] - at), z[block])
            there = (dense != 0).astype(np.float32)
            i, j = np.nonzero(np.triu(there @ there.T > 0))
            yield own[i], own[j], (dense @ dense.T)[i, j]
        return
    reach = np.repeat(starts + sizes, sizes) - np.arange(len(z))  # a call meets itself and those after it in its variant
    upto = np.append(0, np.cumsum(reach))
    at = 0
    while at < len(z):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, side="right")) - 1)
        left = np.repeat(np.arange(at, end), reach[at:end])
        right = left + np.arange(len(left)) - np.repeat(upto[at:end] - upto[at], reach[at:end])
        key = code[left].astype(np.int64) * len(own) + code[right]
        products = z[left] * z[right]
        if len(own) ** 2 <= 4 * limit:
            sums, met = np.bincount(key, products, len(own) ** 2), np.flatnonzero(np.bincount(key, minlength=len(own) ** 2))
            sums = sums[met]
        else:
            met, place = np.unique(key, return_inverse=True)
            sums = np.bincount(place, products)
        yield own[met // len(own)], own[met % len(own)], sums
        at = end


def gram_blocks(z: DataFrame, variants_per_block: int = 32768, products: int = PRODUCTS) -> DataFrame:
    """(i, j, k) with i <= j: sums of z_i z_j over variants, for the pairs that share one.

    Variants are cut into ranges, since neighbours are mostly called in the same samples. A
    task sums the products of a range, some millions at a time, pair by pair: its time
    follows the calls that meet, not the square of the samples. A range leaves a row a pair.
    """
    n_blocks = max(1, -(-z.select("variant").distinct().count() // variants_per_block))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for i, j, k in _pair_sums(*(table.column(c).to_numpy() for c in ("sample", "code", "z")), products):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k)], ["i", "j", "k"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CALLS:  # whole variants only
                table = pa.Table.from_batches(held)
                cut = int(np.searchsorted(table.column("code").to_numpy(), table.column("code")[-1].as_py()))
                if cut:
                    yield from close(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield from close(pa.Table.from_batches(held))

    dealt = z.select(F.col("sample").cast("long").alias("sample"), "variant", "z").repartitionByRange(n_blocks, "variant")
    # variants become numbers that rise within a partition
    coded = dealt.withColumn("code", F.dense_rank().over(W.partitionBy(F.spark_partition_id()).orderBy("variant"))) if dict(z.dtypes)["variant"] not in ("int", "bigint") else dealt.withColumn("code", F.col("variant").cast("long"))
    ordered = coded.select("sample", "code", "z").sortWithinPartitions("code")
    return ordered.mapInArrow(sums, "i long, j long, k double").groupBy("i", "j").agg(F.sum("k").alias("k"))


def filled_dosages(calls: DataFrame, samples: DataFrame, impute: str = "ref") -> DataFrame:
    """(variant, n, fill, at array<long>, d array<double>): vectors as of dosage_vectors, of n places of which those not in at hold fill.

    What is kept of a variant follows its calls, not the samples.
    """
    if impute not in ("ref", "mean"):
        raise ValueError(f"no imputation {impute}")
    ords = numbered(samples, "sample")
    cells = calls.join(ords, "sample").groupBy("variant").agg(F.collect_list("ord").alias("at"), F.collect_list(F.col("dosage").cast("double")).alias("d"), F.avg("dosage").alias("mean"))  # its calls
    fill = F.col("mean") if impute == "mean" else F.lit(0.0)
    return cells.join(F.broadcast(ords.agg(F.count("ord").alias("n")))).select("variant", "n", fill.alias("fill"), "at", "d")


def dosage_vectors(calls: DataFrame, samples: DataFrame, impute: str = "ref") -> DataFrame:
    """(variant, dosages array<double>) with a place for each of samples(sample) in order; a missing call is 0 (ref) or the variant's mean."""
    if impute not in ("ref", "mean"):
        raise ValueError(f"no imputation {impute}")
    ords = numbered(samples, "sample")
    n = ords.count()
    cells = calls.join(ords, "sample").groupBy("variant").agg(F.collect_list("ord").alias("at"), F.collect_list(F.col("dosage").cast("double")).alias("d"))  # a vector's length

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, max(1, (1 << 22) // max(1, n))):
                part = batch.slice(s, max(1, (1 << 22) // max(1, n)))
                dense = np.zeros((part.num_rows, n))
                for row, at, d in zip(dense, part.column(1), part.column(2)):
                    values = d.values.to_numpy()
                    if impute == "mean":
                        row[:] = values.mean()
                    row[at.values.to_numpy()] = values
                offsets = pa.array(np.arange(part.num_rows + 1) * n, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], ["variant", "dosages"])

    return cells.mapInArrow(fill, f"variant {dict(calls.dtypes)['variant']}, dosages array<double>")
