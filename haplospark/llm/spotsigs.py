"""SpotSigs fingerprints.

A signature is a chain of the next CHAIN content words that follow a place of a very
common word (an anchor); words that are anchors themselves never join a chain. The
set of a text's signatures is its fingerprint; likeness is the Jaccard similarity.

For joins, sets are dealt out by length: two sets can reach a threshold only if the
lengths' ratio does, so a set meets only the neighbouring length classes, and within
those only the sets that share one of the rarest signatures of its prefix.

Defined cases: null text counts as empty. A text without a signature (no anchor that
content follows) has one signature made of all its words, so such texts are alike if
their words are the same, and not alike otherwise. Repeated rows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.llm.common import chunks, input_columns, map_rows, materialise

CHAIN = 2
CACHE_ENTRIES = 400_000
#: Anchors, the commonest function words of four languages.
ANCHORS = (
    "a an the of to in is it was that be are for on with as by at this from "
    "de la le les et des un une du en que est pour dans par sur "
    "der die das den und von zu mit ist im ein eine nicht auf "
    "el los las del se con por su una es para al y"
).split()
_STRIP = b".,;:!?\"'()[]{}<>|#*$%&-_/\\"


class Signer:
    """Signature sets of texts; remembers the hashes of words."""

    def __init__(self, anchors: list[str] | None = None, chain: int = CHAIN):
        self.anchors = frozenset(a.encode() for a in anchors or ANCHORS)
        self.chain = chain
        outer = self

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                bare = word.strip(_STRIP)
                if bare in outer.anchors:
                    value = 1
                elif not bare:
                    value = 0
                else:
                    value = xxhash.xxh64_intdigest(bare, 7) | 2
                if len(word) <= 64:
                    if len(self) > CACHE_ENTRIES:
                        self.clear()
                    self[word] = value
                return value

        self.look = Known().__getitem__

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit signatures: 0 is no content, 1 an anchor, the rest content words."""
        words = text.encode().lower().split()
        codes = np.array(list(map(self.look, words)), np.uint64)
        codes = codes[codes != 0]
        is_anchor = codes == 1
        content = codes[~is_anchor]
        after = np.cumsum(~is_anchor)[is_anchor]  # content words before an anchor: where its chain starts
        starts = after[after + self.chain <= len(content)]
        if not len(starts):
            whole = hashlib.sha256(b" ".join(words)).digest()
            return np.frombuffer(whole[:8], "<u8").copy()
        starts = np.unique(starts)
        with np.errstate(over="ignore"):
            sig = np.zeros(len(starts), np.uint64)
            for k in range(self.chain):
                sig = (sig ^ content[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
                sig ^= sig >> np.uint64(29)
        return np.unique(sig)


def digest(signatures: np.ndarray) -> str:
    """A text's fingerprint: the number of signatures and a hash of their sorted set."""
    return f"{len(signatures)}-{hashlib.sha256(signatures.astype('<u8').tobytes()).hexdigest()[:32]}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(rows: DataFrame, rows_per_part: int) -> tuple[np.ndarray, dict[int, int | None], int]:
    """Cuts of the ids into ranges, each non-empty range's largest id, and the number of ranges.

    Ids alone are read, and a number for each range comes to the driver. Null ids make
    range -1, below all others.
    """
    ids = rows.select("id")
    n_parts = max(1, -(-ids.count() // rows_per_part))
    cuts = ids.approxQuantile("id", [i / n_parts for i in range(1, n_parts)], 0.2 / n_parts) if n_parts > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_part_of(batch.column(0), bounds))], ["id", "part"])

    heads = map_rows(ids, "id long, part int", tag).groupBy("part").agg(F.max("id").alias("id")).collect()
    return bounds, {r["part"]: r["id"] for r in heads}, n_parts


def _part_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    parts = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
    return np.where(known, parts, -1).astype(np.int32)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 4096) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare with the next document.

    The next document is the one with the next lower id (an integer; equal ids by
    text, null ids last), after the last one the first. Rows are dealt out in ranges of
    descending ids and read in order; the row that opens the range below is sent along.
    Returns the id column, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A single document is its own next one.
    """
    rows = input_columns(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    bounds, heads, n_parts = _ranges(rows, rows_per_part)
    down = sorted(heads, reverse=True)
    opens = dict(zip(down[1:] + down[:1], down)) if down else {}  # whose first row ends which range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            parts = _part_of(ids, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.ones(len(ids), bool)), ids, batch.column(1)], ["part", "own", "id", "text"])
            head = [heads[p] == i for p, i in zip(parts.tolist(), ids.to_pylist())]
            if any(head):
                keep = pa.array(np.flatnonzero(head))
                to = pa.array([opens[p] for p in parts[np.array(head)].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([False] * len(keep)), ids.take(keep), batch.column(1).take(keep)], ["part", "own", "id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        out: list[tuple] = []
        held = None  # (part, id, text, signatures) of a row that waits for its next one
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for whole in batches:
            for batch in chunks(whole, "text"):
                for part, own, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if not own and held is None:
                        continue
                    text = text or ""
                    signatures = signer(text)
                    if held is not None:
                        _, doc_0, text_0, sig_0 = held
                        new = edited(text_0, text)
                        sig_1 = signer(new)
                        sha = hashlib.sha256(new.encode()).hexdigest()
                        out.append((doc_0, len(text_0), sha, digest(sig_0), digest(sig_1), likeness(sig_0, sig_1), likeness(sig_0, signatures)))
                    held = (part, doc, text, signatures) if own else None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []

    dealt = map_rows(rows, "part int, own boolean, id long, text string", deal).repartition(n_parts, "part")
    dealt = dealt.sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("id"), "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(dealt, schema, compare).withColumnRenamed("id", id_col)


def signature_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sigs, sigs array<long>) of every whole text."""
    rows = input_columns(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = [signer(t or "").view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n_sigs", "sigs"]
                )

    return map_rows(rows, f"id {dict(rows.dtypes)['id']}, n_sigs int, sigs array<long>", run)


def near_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, jaccard) of class representatives with a likeness of threshold or more.

    Texts with equal sets are one class, represented by its smallest id. Sets are dealt
    out by length class; a set probes its own and the next class with the rarest
    signatures of its prefix, and the lengths' ratio prunes before the exact comparison.
    """
    sets = materialise(signature_sets(df, id_col, text_col).groupBy("sigs", "n_sigs").agg(F.min("id").alias("id")))
    step = float(np.log(1 / threshold))
    sets = sets.withColumn("length_class", F.floor(F.log("n_sigs") / step).cast("int"))
    tokens = sets.select("id", "n_sigs", "length_class", F.explode("sigs").alias("sig"))
    rarity = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("id").orderBy("df", "sig")
    prefix = F.col("n_sigs") - F.ceil(F.col("n_sigs") * threshold) + 1
    ranked = tokens.join(rarity, "sig").withColumn("k", F.row_number().over(order)).where(F.col("k") <= prefix)
    left = ranked.select(F.col("id").alias("a"), "sig", F.col("n_sigs").alias("na"), F.explode(F.array(F.col("length_class"), F.col("length_class") + 1)).alias("length_class"))
    right = ranked.select(F.col("id").alias("b"), "sig", F.col("n_sigs").alias("nb"), "length_class")
    ratio = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "length_class"]).where(ratio & ordered).select("a", "b").distinct()
    one = sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one, "a").join(two, "b").withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both))
    return found.where(F.col("jaccard") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
