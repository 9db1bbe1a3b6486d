"""SimHash near-duplicate groups.

Fingerprints are majority bits of XXH64 over word shingles. Distinct fingerprints
within max_distance bits are linked through a segment-popcount embedding: the bits
are cut into segments, each fingerprint becomes the vector of its segments' bit
counts, and the Manhattan distance of two vectors is a lower bound of their Hamming
distance. The vector is cut into max_distance // radius groups of segments such that
one group at least stays within a Manhattan radius of one; that group's counts are
the grid cell, a fingerprint visits its own cell and those one step away, and all
that meet in a cell are verified exactly on the 64 bits. Links of a cell leave as a
spanning forest, never as all pairs. Copies collapse to one fingerprint before the
join, and no more than the fingerprints of a Hamming ball can be close to each other,
so a cell's rows stay bounded however often a text is copied. A cell that many different
fingerprints fill is cut again by slices of their bits.

Defined cases: null or wordless text has fingerprint zero, linked like any other;
a null id never becomes a component id unless its group has no other; repeated rows
give repeated results; an empty table gives no rows; a bit set in exactly half of the
hashes is 0; equal ids share nothing but the id; other columns of the input are ignored,
whatever their names; very long texts are hashed whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import chunks, input_columns, map_rows, materialise, texts_of
from haplospark.llm.components import connected_components

SEED = 42
SEGMENT_BITS = 2
#: Rows of a cell that are compared with one another at once.
FULL_CELL = 512


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row; fp holds the 64 bits as a signed number."""
    rows = input_columns(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return map_rows(rows, f"id {dict(rows.dtypes)['id']}, fp long", run)


def _segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 64 / SEGMENT_BITS segments, one row each."""
    n = 64 // SEGMENT_BITS
    shifts = np.arange(n, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _cells(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fps, cell, visits?) of the grid."""
    counts = _segment_counts(fps)
    n_groups = max_distance // 2 + 1  # so some group has a Manhattan distance of one at most
    base = SEGMENT_BITS + 3
    who, cell, visit = [], [], []
    index = np.arange(len(fps))
    for g, segments in enumerate(np.array_split(np.arange(counts.shape[1]), n_groups)):
        weights = np.array([pow(base, i) for i in range(len(segments))], np.int64)
        home = ((counts[:, segments] + 1) @ weights) * n_groups + g
        who.append(index)
        cell.append(home)
        visit.append(np.zeros(len(fps), bool))
        for s, w in zip(segments, weights):
            for step in (-1, 1):
                inside = (counts[:, s] + step >= 0) & (counts[:, s] + step <= SEGMENT_BITS)
                who.append(index[inside])
                cell.append(home[inside] + step * int(w) * n_groups)
                visit.append(np.ones(int(inside.sum()), bool))
    return np.concatenate(who), np.concatenate(cell), np.concatenate(visit)


def _flood(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (root index, other index)."""
    left = np.arange(len(fps))
    roots, others = [], []
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            near = (np.bitwise_count(fps[left][None, :] ^ fps[block][:, None]) <= max_distance).any(axis=0)
            got, left = left[near], left[~near]
            if len(got):
                roots.append(np.full(len(got), root))
                others.append(got)
                front = np.concatenate([front, got])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *roots]), np.concatenate([empty, *others])


def _cell_links(fps: np.ndarray, visit: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found in one cell. Two visitors need not be compared: their own cells see to them.

    In a full cell the 64 bits are cut once more, into max_distance + 1 slices, of which
    two close fingerprints share one at least; only those with an equal slice are compared.
    """
    if len(fps) <= FULL_CELL:
        return _compare(fps, visit, np.arange(len(fps)), max_distance)
    a, b, found = [], [], 0
    edges = np.linspace(0, 64, max_distance + 2).astype(int)
    for low, high in zip(edges, edges[1:]):
        part = (fps >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(part, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(group) > 1 and not visit[group].all():
                x, y = _compare(fps, visit, group, max_distance)
                a.append(x)
                b.append(y)
                found += len(x)
        if found > 16 * len(fps) + 64:
            return _flood(fps, max_distance)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _compare(fps: np.ndarray, visit: np.ndarray, group: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a group (indexes) of a cell, a home row at one end at least; a forest of the group where they are many."""
    home = group[~visit[group]]
    if not len(home):
        return home, home
    a, b = [], []
    step = max(1, (1 << 20) // len(group))
    found = 0
    for at in range(0, len(home), step):
        rows = home[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[group][None, :]) <= max_distance)
        keep = rows[i] != group[j]
        a.append(rows[i][keep])
        b.append(group[j][keep])
        found += int(keep.sum())
        if found > 4 * len(group) + 64:
            x, y = _flood(fps[group], max_distance)
            return group[x], group[y]
    return np.concatenate(a), np.concatenate(b)


def near_links(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp whose closure is that of all pairs within max_distance."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                who, cell, visit = _cells(part, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[who].view(np.int64)), pa.array(visit)], ["cell", "fp", "visit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(fps: np.ndarray, visit: np.ndarray) -> pa.RecordBatch | None:
            a, b = _cell_links(fps, visit, max_distance)
            if not len(a):
                return None
            x, y = fps[a].view(np.int64), fps[b].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            visit = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(cell)) + 1
            bounds = [0, *cuts.tolist(), len(cell)]
            for s, e in zip(bounds, bounds[1:]):
                if current is not None and cell[s] != current:
                    if held and (out := close(*map(np.concatenate, zip(*held)))) is not None:
                        yield out
                    held = []
                current = cell[s]
                held.append((fps[s:e], visit[s:e]))
        if held and (out := close(*map(np.concatenate, zip(*held)))) is not None:
            yield out

    cells = map_rows(prints.select("fp").distinct(), "cell long, fp long, visit boolean", spread)
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return map_rows(dealt, "a long, b long", meet).distinct()


def near_duplicates(
    df: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of df: the id column, fingerprint (16 hex digits) and component_id, the smallest id of its group."""
    prints = materialise(fingerprints(df, shingle, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(near_links(distinct, max_distance)).toDF("fp", "component")
    grouped = distinct.join(labels, "fp")
    heads = grouped.groupBy("component").agg(F.min("least").alias("least"))
    linked = grouped.select("fp", "component").join(heads, "component").select("fp", "least")
    alone = distinct.join(labels, "fp", "left_anti")
    owner = linked.unionByName(alone)
    return prints.join(owner, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )
