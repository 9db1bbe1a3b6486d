"""Sequence and genotype expressions, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heterozygous base codes, and the digit order of base-4 k-mer ids.
IUPAC = {"A": "0/0", "C": "0/0", "G": "0/0", "T": "0/0", "R": "A/G", "Y": "C/T", "S": "C/G", "W": "A/T", "K": "G/T", "M": "A/C"}
BASES, KMER_BASE, KMER_UNKNOWN = "ATCG", 151672, 151671


def genotype(gt: Column, mode: str) -> Column:
    """Carrier flag of a VCF genotype string. Modes stay apart on purpose: they differ on hets, phase and missing.

    first: the first allele is 1; hom: homozygous ALT, phased or not; exact: the literal 1/1; any: some ALT allele.
    """
    call = F.substring_index(gt, ":", 1)
    rules = {
        "first": F.regexp_extract(call, "^([0-9]+)", 1) == "1",
        "hom": call.isin("1/1", "1|1"),
        "exact": call == "1/1",
        "any": call.rlike("[1-9]"),
    }
    return F.coalesce(rules[mode], F.lit(False)).cast("int")


def dosage(gt: Column) -> Column:
    """ALT alleles 0, 1, 2; null if missing."""
    call = F.substring_index(gt, ":", 1)
    return F.when(~call.rlike(r"^[0-9]+[/|][0-9]+$"), None).otherwise(
        (F.regexp_extract(call, r"^([0-9]+)", 1) != "0").cast("int") + (F.regexp_extract(call, r"([0-9]+)$", 1) != "0").cast("int")
    )


def chrom_number(name: Column) -> Column:
    """Chromosome as a number: prefix chr dropped, null unless an integer remains."""
    bare = F.regexp_replace(F.upper(name), "^CHR", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.cast("int"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def complement(seq: Column) -> Column:
    return F.translate(F.upper(seq), "ACGT", "TGCA")


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """The k-mers that start every step bases; none for shorter sequences. Side by side, or one base on, they are found in one pass."""
    if step == k:
        return F.regexp_extract_all(seq, F.lit(f"(?s).{{{k}}}"), F.lit(0))
    if step == 1:
        return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    starts = F.sequence(F.lit(1), F.length(seq) - k + 1, F.lit(step))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_id(kmer: Column) -> Column:
    """Base-4 id in digit order ATCG above a base; one id for anything that holds another letter."""
    digits = F.transform(F.split(kmer, ""), lambda c: F.instr(F.lit(BASES), c) - 1)
    value = F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda a, d: a * 4 + d)
    return F.when(kmer.rlike(f"^[{BASES}]+$"), value + KMER_BASE).otherwise(KMER_UNKNOWN)


def context_code(b2: Column, b3: Column) -> Column:
    """Cytosine context of the two following bases: 1 CG, 2 CHG, 3 CHH, 0 unknown."""
    return F.when((b2 == "N") | ((b3 == "N") & (b2 != "G")), 0).when(b2 == "G", 1).when(b3 == "G", 2).otherwise(3)


def patch(ref: Column, alts: Column) -> Column:
    """ref with the single bases of alts array<struct<at, base>> (at from 0) laid over it."""
    return F.aggregate(alts, ref, lambda s, a: F.overlay(s, a["base"], a["at"] + 1, F.lit(1)))


def gc_fraction(seq: Column) -> Column:
    """G and C among the known bases; null if there are none."""
    s = F.upper(seq)
    known = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    return F.length(F.regexp_replace(s, "[^GC]", "")) / F.nullif(known, F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def window(bases: Column, start: Column, width: int) -> Column:
    """width bases from start (from 0, perhaps below), N where the sequence does not reach."""
    first = F.greatest(start, F.lit(0))
    inside = F.substring(bases, first + 1, F.greatest(F.lit(0), start + width - first))
    left = F.array_join(F.array_repeat(F.lit("N"), F.greatest(F.lit(0), F.least(-start, F.lit(width)))), "")
    return F.rpad(F.concat(left, inside), width, "N")


def one_hot(bases: Column) -> Column:
    """An array of four flags, in the order A, C, G, T, for each base; none is set for another letter."""
    return F.transform(F.split(bases, ""), lambda c: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: (b == c).cast("int")))


def same_known(a: Column, b: Column) -> Column:
    """Whether two sequences of one length agree wherever both bases are known."""
    agree = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) | (x == "N") | (y == "N"), F.lit(False)))
    return F.forall(agree, lambda ok: ok)


def layer_norm(v: Column, floor: float = 1e-5) -> Column:
    """v less its mean, over the root of its variance plus floor; no parameters."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    root = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n + floor)
    # One-element arrays bind the mean and the root, so that neither is worked out anew for each component.
    scaled = lambda m, r: F.transform(v, lambda x: (x - m) / r)
    return F.transform(F.array(mean), lambda m: F.transform(F.array(root(m)), lambda r: scaled(m, r))[0])[0]
