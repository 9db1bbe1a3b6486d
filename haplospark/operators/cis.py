"""Models of a gene on the variants around it: heritability, ridge on its own kernel, elastic net.

Genes meet variants by a binned interval join; what travels for a variant is its dosage
row, a byte a sample. A task reads a gene's rows in order and adds them up at once into a
matrix over samples, so a gene's variants are never gathered; a gene with more than
PART_VARIANTS of them is dealt out in parts, whose matrices are summed afterwards.
Models then take that matrix: samples squared, whatever the number of variants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from haplospark.operators import elastic_net
from haplospark.operators.gram import ROWS, standardise, unpack
from haplospark.operators.interval import point_in_interval
from haplospark.operators.kernel import PENALTIES, check_samples, choose_penalty

#: Variants of a gene that one task adds up; beyond, parts of the gene are dealt out.
PART_VARIANTS = 100_000
#: Of a gene's variants the most correlated with its training values that elastic net sees.
SCREEN = 3000


def windows(rows: DataFrame, genes: DataFrame, half: int) -> DataFrame:
    """(gene, variant, dosages) of rows(variant, chrom, pos, dosages) within half bases of genes(gene, chrom, tss), both ends in."""
    spans = genes.select("gene", "chrom", (F.col("tss") - half).alias("start"), (F.col("tss") + half).alias("end"))
    return point_in_interval(rows, spans, ["chrom"], "pos", "start", "end", "both", 2 * half + 1).select("gene", "variant", "dosages")


def gene_targets(values: DataFrame, ids: list) -> DataFrame:
    """(gene, y array<double>) of values(gene, sample, value), a place for each of ids in order; a missing value is null."""
    kind = dict(values.dtypes)["sample"]
    order = values.sparkSession.createDataFrame([(x, n) for n, x in enumerate(ids)], f"sample {kind}, ord int")
    cell = F.struct(F.col("ord"), F.col("value").cast("double").alias("v"))
    cells = values.where("value is not null").join(F.broadcast(order), "sample").groupBy("gene").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))  # a row a sample
    return cells.select("gene", F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), lambda k: F.try_element_at("m", k)).alias("y"))


def _dealt(cis: DataFrame, targets: DataFrame, n_parts: DataFrame) -> DataFrame:
    """(gene, part, y, dosages) for the genes of n_parts: for each part of a gene a row with y, then its variants, one partition a part."""
    heads = targets.join(n_parts, "gene").select("gene", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "y", F.lit(None).cast("binary").alias("dosages"))
    body = cis.join(n_parts, "gene").select(
        "gene", F.pmod(F.xxhash64("variant"), F.col("n_parts")).cast("int").alias("part"), F.lit(None).cast("array<double>").alias("y"), "dosages"
    )
    rows = heads.unionByName(body).withColumn("rest", F.col("y").isNull())
    return rows.repartition("gene", "part").sortWithinPartitions("gene", "part", "rest").select("gene", "part", "y", "dosages")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list | None, pa.Array]]:
    """(gene, y, dosages) in pieces of up to ROWS variants: y comes with a part's first piece, which has no variant yet, and is None in the others."""
    current = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        at = 0
        while at < len(keys):
            if keys[at] != current:
                current = keys[at]
                yield current[0], batch.column(2)[at].as_py(), batch.column(3).slice(at, 0)
                at += 1
                continue
            end = at
            while end < len(keys) and end - at < ROWS and keys[end] == current:
                end += 1
            yield current[0], None, batch.column(3).slice(at, end - at)
            at = end


def _sums(batches: Iterator[pa.RecordBatch], parts: np.ndarray, maf_min: float) -> Iterator[tuple[object, list, np.ndarray, int]]:
    """(gene, y, sum of z z', variants) of each gene's part."""
    n, held = len(parts), None
    for gene, y, dosages in _runs(batches):
        if y is not None:
            if held:
                yield held
            held = (gene, y, np.zeros((n, n)), 0)
            continue
        z = standardise(unpack(dosages, n), parts, maf_min)
        held = (*held[:2], held[2] + z.T @ z, held[3] + len(z))
    if held:
        yield held


def gene_matrices(
    cis: DataFrame, targets: DataFrame, parts: np.ndarray, solve: Callable[[np.ndarray, int, np.ndarray], tuple], schema: str, maf_min: float = 0.0
) -> DataFrame:
    """One row for each of targets(gene, y): the gene, n_cis (variants), and what solve(sum of z z', n_cis, y) returns under schema.

    cis is the result of windows(); parts has the part of each sample, 0 for training. A
    gene without variants has n_cis 0 and nulls.
    """
    check_samples(len(parts))
    kind = dict(targets.dtypes)["gene"]
    names = ["gene", "n_cis", *[c.split()[0] for c in schema.split(", ")]]

    def rows(found: Iterator[tuple[object, list, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        for gene, y, total, p in found:
            solved = solve(total, p, np.array(y, np.float64)) if p else (None,) * (len(names) - 2)
            yield pa.RecordBatch.from_pylist([dict(zip(names, (gene, p, *solved)))], arrow)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(_sums(batches, parts, maf_min))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gene, y, total, p in _sums(batches, parts, maf_min):
            yield pa.RecordBatch.from_pylist([{"gene": gene, "y": y, "p": p, "total": total.tobytes()}], partial)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, np.ndarray, int]]:
        held = None
        for batch in batches:
            for one in batch.to_pylist():
                total = np.frombuffer(one["total"]).reshape(len(parts), -1)
                if held and held[0] == one["gene"]:
                    held = (*held[:2], held[2] + total, held[3] + one["p"])
                    continue
                if held:
                    yield held
                held = (one["gene"], one["y"], total, one["p"])
        if held:
            yield held

    def big(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(merged(batches))

    result, state = f"gene {kind}, n_cis long, {schema}", f"gene {kind}, y array<double>, p long, total binary"
    arrow, partial = (to_arrow_schema(StructType.fromDDL(s)) for s in (result, state))
    found = cis.groupBy("gene").agg(F.ceil(F.count(F.lit(1)) / PART_VARIANTS).cast("int").alias("n_parts"))
    n_parts = targets.select("gene").join(found, "gene", "left").select("gene", F.coalesce("n_parts", F.lit(1)).alias("n_parts"))
    whole = _dealt(cis, targets, n_parts.where("n_parts = 1")).mapInArrow(small, result)
    cut = _dealt(cis, targets, n_parts.where("n_parts > 1")).mapInArrow(add, state)
    return whole.unionByName(cut.repartition("gene").sortWithinPartitions("gene").mapInArrow(big, result))


def haseman_elston(products: np.ndarray, *kernels: np.ndarray) -> list[float] | None:
    """Slopes of products(i, j) on the kernels' values over all pairs i < j, with an intercept; None where pairs do not tell the kernels apart."""
    def over_pairs(m: np.ndarray) -> float:
        return (m.sum() - np.trace(m)) / 2

    m = len(products) * (len(products) - 1) / 2
    if not m:
        return None
    means = [over_pairs(k) / m for k in kernels]
    cross = np.array([[over_pairs(a * b) / m - x * y for b, y in zip(kernels, means)] for a, x in zip(kernels, means)])
    with_target = np.array([over_pairs(k * products) / m - x * over_pairs(products) / m for k, x in zip(kernels, means)])
    if np.linalg.det(cross) <= 1e-9 * np.prod(np.diag(cross)):
        return None
    return np.linalg.solve(cross, with_target).tolist()


#: What kernel_models returns for a gene, besides its name and n_cis.
KERNEL_SCHEMA = "cis_h2 double, glob_h2 double, penalty double, y array<double>, predicted array<double>"


def kernel_models(cis: DataFrame, targets: DataFrame, parts: np.ndarray, relatives: np.ndarray, maf_min: float = 0.0, penalties: np.ndarray = PENALTIES) -> DataFrame:
    """(gene, n_cis, cis_h2, glob_h2, penalty, y, predicted) of each gene.

    cis_h2 and glob_h2: Haseman-Elston regression of the products of training values on the
    gene's own kernel and on relatives (the kinship of all samples) at once, clipped to 0 to 1.
    predicted: ridge on the gene's own kernel, its penalty by leave-one-out, for the samples
    outside training (in order, beside their y); its training mean is added back. Samples
    without a value are left out of the training; fewer than three leave nulls.
    """
    shared = cis.sparkSession.sparkContext.broadcast(relatives)
    held = np.flatnonzero(parts != 0)

    def solve(total: np.ndarray, p: int, y: np.ndarray) -> tuple:
        kernel = total / p
        train = np.flatnonzero((parts == 0) & np.isfinite(y))
        truth = [None if np.isnan(x) else float(x) for x in y[held]]
        if len(train) < 3:
            return None, None, None, truth, None
        inner, mean = kernel[np.ix_(train, train)], y[train].mean()
        left = y[train] - mean
        h2 = (None, None)
        if left.var() > 1e-12:
            slopes = haseman_elston(np.outer(left, left) / left.var(), inner, shared.value[np.ix_(train, train)])
            h2 = tuple(min(max(s, 0.0), 1.0) for s in slopes) if slopes else h2
        penalty, _, weights = choose_penalty(inner, left[None], penalties)
        return *h2, float(penalty[0]), truth, (kernel[np.ix_(held, train)] @ weights[0] + mean).tolist()

    return gene_matrices(cis, targets, parts, solve, KERNEL_SCHEMA, maf_min)


def sparse_models(
    cis: DataFrame, targets: DataFrame, parts: np.ndarray, maf_min: float = 0.0, screen: int = SCREEN, l1_ratio: float = 0.5, n_penalties: int = 12, folds: int = 3
) -> DataFrame:
    """(gene, n_cis, n_used, penalty, n_nonzero, y, predicted): elastic net of each of targets(gene, y), its penalty by cross-validation.

    Of a gene's variants, which come one after another, only the screen most correlated
    with the training values are held (of equal ones those met first). Give it the genes
    worth it, such as those that kernel_models finds heritable.
    """
    n = len(parts)
    check_samples(n)
    held = np.flatnonzero(parts != 0)
    kind = dict(targets.dtypes)["gene"]
    schema = f"gene {kind}, n_cis long, n_used long, penalty double, n_nonzero long, y array<double>, predicted array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fit(gene: object, y: np.ndarray, z: np.ndarray, p: int) -> pa.RecordBatch:
        train = np.flatnonzero((parts == 0) & np.isfinite(y))
        row = {"gene": gene, "n_cis": p, "n_used": len(z), "y": [None if np.isnan(x) else float(x) for x in y[held]]}
        if len(z) and len(train) >= folds:
            penalty, weights, intercept = elastic_net.cross_validated(z[:, train].T, y[train], l1_ratio, n_penalties, folds)
            row |= {"penalty": penalty, "n_nonzero": int((weights != 0).sum()), "predicted": (z[:, held].T @ weights + intercept).tolist()}
        return pa.RecordBatch.from_pylist([row], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gene = y = None
        for name, values, dosages in _runs(batches):
            if values is not None:
                if y is not None:
                    yield fit(gene, y, best, p)
                gene, y, best, p = name, np.array(values, np.float64), np.zeros((0, n)), 0
                train = np.flatnonzero((parts == 0) & np.isfinite(y))
                left = y[train] - y[train].mean() if len(train) else np.zeros(0)
                continue
            z = standardise(unpack(dosages, n), parts, maf_min)
            p += len(z)
            best = np.concatenate([best, z])
            if len(best) > screen:
                strength = np.abs(best[:, train] @ left).round(9)
                best = best[np.sort(np.argsort(-strength, kind="stable")[:screen])]
        if y is not None:
            yield fit(gene, y, best, p)

    one_part = targets.select("gene", F.lit(1).alias("n_parts"))
    return _dealt(cis, targets, one_part).mapInArrow(run, schema)
