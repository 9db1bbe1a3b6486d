"""Exact removal of repeated passages, by bucketed names of suffixes with a difference cover.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller
id, or the same document and an earlier start) is removed. Only the order's ties
matter here, so suffixes are sorted by names of their prefixes.

1. Texts are packed into blocks and written once to the shared folder.
2. Cover sample: of every ``v`` start positions the |D| whose residue is in a difference
   cover D modulo v are named by their next ``length - v + 1`` bytes. Two equal strings of
   ``length`` bytes always share a sampled start at the same distance, so a string can
   tie with another only if it holds a sampled name that occurs twice.
3. The suffixes that can tie are bucketed by the name of their first ``length`` bytes, and
   one group of buckets at a time is dealt out, sorted and searched for all but the
   first of each tie. That bounds disk and memory whatever the number of suffixes.
4. Equal names are no proof. Each tie is a later suffix and the first of its name; the later
   one's text is sent to the first one's block, as runs, and the bytes are compared there.
   Suffixes of a name that stands for more than one string are resolved by their bytes.
5. The ties are drawn in the blocks as removed runs.

A name that a block holds often leaves it once, so a passage that stands in a third
of all documents is one entry a block. Sampled names are 32 bits within a bucket of
bounded size (a chance hit only lets a few more suffixes in); suffix names are 64 bits.
Whole copies of a document are known by 128 bits of its SHA-256.

Defined cases: null text counts as empty; texts shorter than ``length`` lose nothing;
null ids come after all others; rows with equal ids are ordered by a hash of their
text; repeated rows are copies, of which one stays whole; an empty table gives no rows;
other columns are ignored, whatever their names, unless named in keep; a text longer than
a block is a block of its own, held whole.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import map_rows, materialise

#: Perfect difference sets by modulus.
COVERS = {
    7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52),
}
BLOCK_BYTES = 2 << 20
BUCKET_ENTRIES = 1 << 20
PASSES = 3
ROW = "block long, kind int, no int, a binary, b binary, c binary, d binary"
NAMES = ["block", "kind", "no", "a", "b", "c", "d"]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest known cover that leaves names of 0.4 length or more; modulus 1 (every position) for short strings."""
    fit = [v for v in COVERS if v <= 0.6 * length and length - v + 1 >= 8]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _offsets(length: int) -> list[int]:
    """Where the words of 8 bytes start that cover a string of length bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def names_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the length bytes from each position (length 8 or more)."""
    if not len(at):
        return np.zeros(0, np.uint64)
    words, size = _words(data), 1 << 14
    if 2 * len(at) < len(data):
        return np.concatenate([_mixed([words[at[s : s + size] + o] for o in _offsets(length)], length) for s in range(0, len(at), size)])
    words = np.ascontiguousarray(words)  # nearly all positions: neighbours share their words
    every = np.empty(len(data) - length + 1, np.uint64)
    for s in range(0, len(every), size):
        e = min(len(every), s + size)
        every[s:e] = _mixed([words[s + o : e + o] for o in _offsets(length)], length)
    return every[at]


def _mixed(words: list[np.ndarray], length: int) -> np.ndarray:
    out = np.full(len(words[0]), length, np.uint64)
    for word in words:
        out ^= word
        out *= _MIX
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of length bytes at these positions of a are those at the positions of b.

    Where both positions go on by one for a while, each byte is compared once.
    """
    out = np.ones(len(at), bool)
    if not len(at):
        return out
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(to) != 1)]))
    n = np.diff(np.concatenate([heads, [len(at)]]))
    short = np.flatnonzero(np.repeat(n < 12, n))
    left, right, same = _words(a), _words(b), np.ones(len(short), bool)
    for offset in _offsets(length) if len(short) else ():
        same &= left[at[short] + offset] == right[to[short] + offset]
    out[short] = same
    heads, m = heads[n >= 12], n[n >= 12]
    sizes = m + length - 1
    base = np.cumsum(sizes) - sizes
    step = np.arange(sizes.sum())
    differ = a[step + np.repeat(at[heads] - base, sizes)] != b[step + np.repeat(to[heads] - base, sizes)]
    bad = np.zeros(len(step) + 1, np.int32)
    np.cumsum(differ, out=bad[1:])
    starts = np.repeat(base - (np.cumsum(m) - m), m) + np.arange(m.sum())
    out[np.repeat(n >= 12, n)] = bad[starts + length] == bad[starts]
    return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four planes of bytes, which compress well where they are small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _row(block: int, kind: int, no: int, *parts: bytes) -> tuple:
    return (block, kind, no, *parts, *[b""] * (4 - len(parts)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(7))


class Block:
    """Documents in order of (id, hash): ids, sizes, hashes and the bytes of all texts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, shas: np.ndarray, data: np.ndarray):
        self.ids, self.sizes, self.shas, self.data = ids, sizes, shas, data
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def unpack(cls, a: bytes, b: bytes) -> Block:
        head = np.frombuffer(a, np.dtype([("id", "<i8"), ("size", "<i8"), ("sha", "<u8"), ("sha2", "<u8")]))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
        return cls(head["id"].copy(), head["size"].copy(), head["sha"].copy(), data)

    def cover(self, length: int) -> np.ndarray:
        """Sampled start positions, for texts of length bytes or more."""
        v, residues = cover_for(length)
        m = length - v + 1
        big = self.sizes >= length
        starts, sizes = self.starts[big], self.sizes[big]
        out = []
        for d in residues:
            n = np.maximum(0, (sizes - m - d) // v + 1)
            first = np.cumsum(n) - n
            out.append(np.repeat(starts + d, n) + (np.arange(n.sum()) - np.repeat(first, n)) * v)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pack_blocks(rows: DataFrame, keep: list[str], block_bytes: int) -> DataFrame:
    """Rows of kind 0: a heads, b texts, c the kept columns as an Arrow batch, d which ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = no = 0

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [(x or "").encode() for x in table.column("__text").to_pylist()]
            ids = table.column("__id").to_pylist()
            heads = []
            for i, (doc, text) in enumerate(zip(ids, texts)):
                sha = hashlib.sha256(text).digest()
                heads.append((_LAST if doc is None else doc, sha[:16], i))
            order = [h[2] for h in sorted(heads)]
            head = np.zeros(len(order), np.dtype([("id", "<i8"), ("size", "<i8"), ("sha", "<u8"), ("sha2", "<u8")]))
            for k, i in enumerate(order):
                doc, sha, _ = heads[i]
                head[k] = (doc, len(texts[i]), int.from_bytes(sha[:8], "big"), int.from_bytes(sha[8:], "big"))
            sink = pa.BufferOutputStream()
            rest = table.select(keep).take(pa.array(order)).combine_chunks()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rest)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts[i] for i in order))
            nulls = np.array([ids[i] is None for i in order], bool).tobytes()
            return _batch([_row((part << 36) + no, 0, 0, head.tobytes(), data, sink.getvalue().to_pybytes(), nulls)])

        for whole in batches:
            sizes = pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < whole.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at:]) + size, block_bytes) + 1
                piece = whole.slice(at, int(room))
                held.append(piece)
                size += int(sizes[at : at + piece.num_rows].sum())
                at += piece.num_rows
                if size >= block_bytes:
                    yield emit()
                    held, size, no = [], 0, no + 1
        if held and sum(b.num_rows for b in held):
            yield emit()

    return map_rows(rows, ROW, run)


def _pack_lists(rows: DataFrame, column: str, kind: int) -> DataFrame:
    """Rows of this kind: a lists the block's numbers in the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_row(b, kind, 0, np.array(i, "<i4").tobytes()) for b, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if out:
                yield _batch(out)

    return map_rows(rows.groupBy("block").agg(F.collect_list(column).alias(column)).select("block", column), ROW, run)


def _copies(blocks: DataFrame, length: int) -> DataFrame:
    """Rows of kind 1: a lists the block's documents that are whole copies of an earlier one."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(a, np.dtype([("id", "<i8"), ("size", "<i8"), ("sha", "<u8"), ("sha2", "<u8")]))
                i = np.flatnonzero(h["size"] >= length)
                columns = [h["sha"][i].view(np.int64), h["sha2"][i].view(np.int64), h["id"][i], np.full(len(i), block), i.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["s", "t", "id", "block", "i"])

    docs = map_rows(blocks.select("block", "a"), "s long, t long, id long, block long, i int", heads)
    first = docs.groupBy("s", "t").agg(F.min(F.struct("id", "block", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = docs.join(first, ["s", "t"]).where("struct(id, block, i) <> first")
    return _pack_lists(later, "i", 1)


def _by_run(rows: Iterator[tuple], key: int) -> Iterator[list[tuple]]:
    """Consecutive rows with one value in field key."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _sample_keys(block: Block, length: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions and, of their names, the distinct keys (bucket << 32 | name), inverse and counts."""
    at = block.cover(length)
    names = names_at(block.data, at, length - cover_for(length)[0] + 1)
    keys = ((names >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (names & np.uint64(0xFFFFFFFF))
    distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return at, distinct, inverse, counts


def _splits(buckets: np.ndarray, n_buckets: int) -> np.ndarray:
    return np.searchsorted(buckets, np.arange(n_buckets + 1))


def _repeated_samples(blocks: DataFrame, length: int, n_buckets: int, deal: int) -> DataFrame:
    """Rows of kind 2, no the bucket: a has a bit for each distinct sampled name of the block in the bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, distinct, _, _ = _sample_keys(Block.unpack(row[3], row[4]), length, n_buckets)
            cuts = _splits(distinct >> np.uint64(32), n_buckets)
            low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
            out = [_row(row[0], 2, k, low[s:e].tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            if out:
                yield _batch(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _by_run(_rows(batches), 2):
            parts = [np.frombuffer(r[3], "<u4") for r in run]
            every = np.sort(np.concatenate(parts))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for r, part in zip(run, parts):
                at = np.searchsorted(twice, part)
                hit = np.zeros(len(part), bool)
                inside = at < len(twice)
                hit[inside] = twice[at[inside]] == part[inside]
                if hit.any():
                    out.append(_row(r[0], 2, r[2], np.packbits(hit).tobytes()))
            if out:
                yield _batch(out)

    dealt = map_rows(blocks, ROW, send).repartition(deal, "no").sortWithinPartitions("no", "block")
    return map_rows(dealt, ROW, answer)


class Candidates:
    """Runs of suffixes that can tie: document, first position in the run's text, number of suffixes; and the text."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, shas: np.ndarray, data: np.ndarray, length: int):
        self.doc, self.start, self.n, self.ids, self.shas, self.data = doc, start, n, ids, shas, data
        sizes = n + length - 1
        self.base = np.cumsum(sizes) - sizes
        self.first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.base - self.first, n)
        self.names = names_at(data, at, length)

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and offset of the suffixes with these numbers."""
        run = np.searchsorted(self.first, k, side="right") - 1
        return self.doc[run], self.start[run] + k - self.first[run]

    def bytes_at(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run of the suffixes with these numbers, and where they start in data."""
        run = np.searchsorted(self.first, k, side="right") - 1
        return run, self.base[run] + k - self.first[run]

    def ambiguous(self, length: int) -> np.ndarray:
        """Names that stand for more than one string in the block."""
        _, first, inverse = np.unique(self.names, return_index=True, return_inverse=True)
        later = np.flatnonzero(first[inverse] != np.arange(len(inverse)))
        same = _equal(self.data, self.bytes_at(later)[1], self.data, self.bytes_at(first[inverse[later]])[1], length)
        return self.names[later[~same]]

    def pack(self) -> tuple[bytes, bytes, bytes]:
        runs = np.stack([self.doc, self.start, self.n]).astype("<i8").tobytes()
        heads = np.concatenate([self.ids, self.shas.view(np.int64)]).astype("<i8").tobytes()
        return runs, heads, zstandard.ZstdCompressor(level=3).compress(self.data.tobytes())

    @classmethod
    def unpack(cls, a: bytes, b: bytes, c: bytes, length: int) -> Candidates:
        runs = np.frombuffer(a, "<i8").reshape(3, -1)
        heads = np.frombuffer(b, "<i8").reshape(2, -1)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint8)
        return cls(runs[0], runs[1], runs[2], heads[0], heads[1].view(np.uint64), data, length)

    def firsts(self, n_buckets: int, of_pass: int = 0, passes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pass's buckets: the first suffix of each name, ordered by (bucket, position); its bucket; which suffixes come later."""
        bucket = (self.names >> np.uint64(20)) % np.uint64(n_buckets)
        own = np.flatnonzero(bucket % np.uint64(passes) == of_pass) if passes > 1 else np.arange(len(bucket))
        _, first = np.unique(self.names[own], return_index=True)
        first = own[first]
        later = np.zeros(len(self.names), bool)
        later[own] = True
        later[first] = False
        key = np.sort(bucket[first] << np.uint64(40) | first.astype(np.uint64))
        return (key & np.uint64((1 << 40) - 1)).astype(np.int64), key >> np.uint64(40), later


def _gather(run: list[tuple], kind: int) -> list[tuple]:
    return [r for r in run if r[1] == kind]


def _candidates(blocks: DataFrame, copies: DataFrame, samples: DataFrame, length: int, n_buckets: int, deal: int) -> DataFrame:
    """Rows of kind 3: a runs, b ids and hashes, c the runs' text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_run(_rows(batches), 0):
            if group[0][1] != 0:
                continue
            block = Block.unpack(group[0][3], group[0][4])
            at, distinct, inverse, counts = _sample_keys(block, length, n_buckets)
            twice = counts > 1
            cuts = _splits(distinct >> np.uint64(32), n_buckets)
            for r in _gather(group, 2):
                s, e = cuts[r[2]], cuts[r[2] + 1]
                twice[s:e] |= np.unpackbits(np.frombuffer(r[3], np.uint8), count=int(e - s)).astype(bool)
            hit = at[twice[inverse]]
            reach = cover_for(length)[0] - 1
            edge = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(edge, np.maximum(hit - reach, 0), 1)
            np.add.at(edge, hit + 1, -1)
            can = np.cumsum(edge[:-1]) > 0
            sizes = block.sizes.copy()
            for r in _gather(group, 1):
                sizes[np.frombuffer(r[3], "<i4")] = 0
            allowed = np.zeros(len(block.data) + 1, np.int32)
            n = np.maximum(0, sizes - length + 1)
            np.add.at(allowed, block.starts, np.where(n > 0, 1, 0))
            np.add.at(allowed, block.starts + n, np.where(n > 0, -1, 0))
            can &= np.cumsum(allowed[:-1]) > 0
            first = np.zeros(len(block.data) + 1, bool)
            first[block.starts] = True
            change = np.flatnonzero(can & (first[:-1] | ~np.concatenate([[False], can[:-1]])))
            if not len(change):
                continue
            doc = np.searchsorted(block.starts, change, side="right") - 1
            total = np.cumsum(can)
            ends = np.concatenate([change[1:], [len(can)]])
            count = total[ends - 1] - total[change] + 1
            long = count + length - 1
            base = np.cumsum(long) - long
            take = np.repeat(change, long) + np.arange(long.sum()) - np.repeat(base, long)
            found = Candidates(doc, change - block.starts[doc], count, block.ids, block.shas, block.data[take], length)
            yield _batch([_row(group[0][0], 3, 0, *found.pack())])

    every = blocks.withColumn("c", F.lit(b"")).union(copies).union(samples)
    dealt = every.repartition(deal, "block").sortWithinPartitions("block", "kind", "no")
    return map_rows(dealt, ROW, run)


def _ties(candidates: DataFrame, length: int, n_buckets: int, of_pass: int, passes: int, deal: int) -> DataFrame:
    """Rows of kind 4, no the bucket: a has a bit for each of the block's first suffixes in the bucket that comes later elsewhere.

    For those with a bit, c has the number in b of the block that holds the first suffix of the name, and d that suffix's number there.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = Candidates.unpack(row[3], row[4], row[5], length)
            first, bucket, _ = found.firsts(n_buckets, of_pass, passes)
            cuts = _splits(bucket, n_buckets)
            out = []
            for k in range(of_pass, n_buckets, passes):
                s, e = cuts[k], cuts[k + 1]
                if e > s:
                    docs = found.places(first[s:e])[0]
                    heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                    runs = np.diff(np.concatenate([heads, [e - s]]))
                    d = docs[heads]
                    keys = np.stack([found.ids[d], found.shas[d].view(np.int64), runs]).astype("<i8")
                    out.append(_row(row[0], 4, k, found.names[first[s:e]].astype("<u8").tobytes(), keys.tobytes(), _planes(np.diff(first[s:e], prepend=0))))
            if out:
                yield _batch(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _by_run(_rows(batches), 2):
            names = np.concatenate([np.frombuffer(r[3], "<u8") for r in run])
            keys = np.concatenate([np.frombuffer(r[4], "<i8").reshape(3, -1) for r in run], axis=1)
            order = np.lexsort((keys[1].view(np.uint64), keys[0]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rank = np.repeat(rank, keys[2])
            by = np.argsort(rank, kind="stable")
            by = by[np.argsort(names[by], kind="stable")]
            sorted_names = names[by]
            head = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
            later = np.zeros(len(names), bool)
            later[by] = ~head
            source = np.empty(len(names), np.int64)
            source[by] = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
            number = np.concatenate([np.cumsum(_unplane(r[5])) for r in run])
            of_row = np.repeat(np.arange(len(run)), [len(r[3]) // 8 for r in run])
            holders = np.array([r[0] for r in run], "<i8")
            at, out = 0, []
            for r in run:
                n = len(r[3]) // 8
                bits = later[at : at + n]
                from_ = source[at : at + n][bits]
                at += n
                if len(from_):
                    rows, which = np.unique(of_row[from_], return_inverse=True)
                    out.append(_row(r[0], 4, r[2], np.packbits(bits).tobytes(), holders[rows].tobytes(), _planes(which), _planes(number[from_])))
            if out:
                yield _batch(out)

    dealt = map_rows(candidates, ROW, send).repartition(deal, "no").sortWithinPartitions("no", "block")
    return map_rows(dealt, ROW, answer)


def _ambiguous(candidates: DataFrame, ties: DataFrame, length: int, n_buckets: int, deal: int) -> np.ndarray:
    """Names that stand for more than one string, found by comparing the bytes of each tie with the first suffix of its name."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 5 for the block of the first suffixes: a their numbers and the sizes of runs, b the later suffixes' text."""
        for group in _by_run(_rows(batches), 0):
            asked = _gather(group, 4)
            if not asked:
                continue
            (own,) = _gather(group, 3)
            found = Candidates.unpack(own[3], own[4], own[5], length)
            first, bucket, _ = found.firsts(n_buckets)
            cuts = _splits(bucket, n_buckets)
            parts = []
            for t in asked:
                s, e = cuts[t[2]], cuts[t[2] + 1]
                bits = np.unpackbits(np.frombuffer(t[3], np.uint8), count=int(e - s)).astype(bool)
                parts.append(np.stack([np.frombuffer(t[4], "<i8")[_unplane(t[5])], first[s:e][bits], _unplane(t[6])]))
            holder, k, to = np.concatenate(parts, axis=1)
            order = np.lexsort((k, holder))
            holder, k, to = holder[order], k[order], to[order]
            of_run, at = found.bytes_at(k)
            new = (np.diff(holder) != 0) | (np.diff(k) != 1) | (np.diff(to) != 1) | (np.diff(of_run) != 0)
            heads = np.flatnonzero(np.concatenate([[True], new]))
            n = np.diff(np.concatenate([heads, [len(k)]]))
            edges = np.flatnonzero(np.concatenate([[True], np.diff(holder[heads]) != 0, [True]]))
            for s, e in zip(edges, edges[1:]):
                h, sizes = heads[s:e], n[s:e] + length - 1
                take = np.arange(sizes.sum()) + np.repeat(at[h] - (np.cumsum(sizes) - sizes), sizes)
                text = zstandard.ZstdCompressor(level=3).compress(found.data[take].tobytes())
                yield _batch([_row(int(holder[h[0]]), 5, 0, np.stack([to[h], n[s:e]]).astype("<i8").tobytes(), text)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = None, -1
        for row in _rows(batches):
            if row[1] == 3:
                found, held = Candidates.unpack(row[3], row[4], row[5], length), row[0]
                bad = found.ambiguous(length)
            else:
                if row[0] != held:
                    raise RuntimeError("a tie with a block that has no suffix")
                to, n = np.frombuffer(row[3], "<i8").reshape(2, -1)
                text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[4]), np.uint8)
                sizes = n + length - 1
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = np.repeat(to, n) + i
                same = _equal(found.data, found.bytes_at(k)[1], text, np.repeat(np.cumsum(sizes) - sizes, n) + i, length)
                bad = found.names[k[~same]]
            if len(bad):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bad).view(np.int64))], ["name"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(deal, "block").sortWithinPartitions("block", "kind", "no")

    asks = map_rows(dealt(candidates.union(ties)), ROW, ask)
    names = map_rows(dealt(candidates.union(asks)), "name long", compare).distinct().collect()
    return np.sort(np.array([r[0] for r in names], np.int64).view(np.uint64))


def _by_bytes(candidates: DataFrame, bad: np.ndarray, length: int) -> DataFrame:
    """Rows of kind 6: a lists the block's suffixes with these names whose very bytes start earlier."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = Candidates.unpack(row[3], row[4], row[5], length)
            k = np.flatnonzero(np.isin(found.names, bad))
            if len(k):
                at, doc = found.bytes_at(k)[1], found.places(k)[0]
                sha = (found.shas[doc] ^ np.uint64(1 << 63)).view(np.int64)  # in unsigned order
                columns = [found.ids[doc], sha, np.full(len(k), row[0]), k.astype(np.int32)]
                text = pa.array([found.data[x : x + length].tobytes() for x in at], pa.binary())
                yield pa.RecordBatch.from_arrays([text, *[pa.array(np.ascontiguousarray(c)) for c in columns]], ["s", "id", "sha", "block", "k"])

    every = map_rows(candidates, "s binary, id long, sha long, block long, k int", send)
    first = every.groupBy("s").agg(F.min(F.struct("id", "sha", "block", "k")).alias("first"))
    return _pack_lists(every.join(first, "s").where("struct(id, sha, block, k) <> first"), "k", 6)


def _cut(blocks: DataFrame, copies: DataFrame, candidates: DataFrame, ties: DataFrame, bad: np.ndarray, length: int, n_buckets: int,
         deal: int, keep: list[str], schema: str, with_text: bool) -> DataFrame:
    """The documents without what was drawn as removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_run(_rows(batches), 0):
            block = Block.unpack(group[0][3], group[0][4])
            edge = np.zeros(len(block.data) + 1, np.int32)
            for r in _gather(group, 3):
                found = Candidates.unpack(r[3], r[4], r[5], length)
                first, bucket, later = found.firsts(n_buckets)
                cuts = _splits(bucket, n_buckets)
                for t in _gather(group, 4):
                    s, e = cuts[t[2]], cuts[t[2] + 1]
                    later[first[s:e]] |= np.unpackbits(np.frombuffer(t[3], np.uint8), count=int(e - s)).astype(bool)
                if len(bad):
                    later[np.isin(found.names, bad)] = False
                    for t in _gather(group, 6):
                        later[np.frombuffer(t[3], "<i4")] = True
                doc, offset = found.places(np.flatnonzero(later))
                at = block.starts[doc] + offset
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            for r in _gather(group, 1):
                i = np.frombuffer(r[3], "<i4")
                np.add.at(edge, block.starts[i], 1)
                np.add.at(edge, block.starts[i] + block.sizes[i], -1)
            gone = np.cumsum(edge[:-1]) > 0
            data = block.data.tobytes()
            removed, spans, shas, texts = [], [], [], []
            for s, n in zip(block.starts.tolist(), block.sizes.tolist()):
                own = gone[s : s + n]
                if own.any():
                    begins = own & ~np.concatenate([[False], own[:-1]])
                    removed.append(int(own.sum()))
                    spans.append(int(begins.sum()))
                    kept = block.data[s : s + n][~own].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                    kept = data[s : s + n]
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            rest = pa.ipc.open_stream(group[0][5]).read_all().combine_chunks()
            nulls = np.frombuffer(group[0][6], bool)
            columns = [pa.array(block.ids, mask=nulls), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)]
            names = ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("__text")
            kept_columns = [rest.column(k).combine_chunks() if rest.num_rows else pa.array([], rest.schema.field(k).type) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, *kept_columns], [*names, *keep])

    every = blocks.union(copies).union(candidates).union(ties)
    dealt = every.repartition(deal, "block").sortWithinPartitions("block", "kind", "no")
    return map_rows(dealt, schema, run)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what was just written, before the next pass writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(
    df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    with_text: bool = False, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, passes: int = PASSES,
) -> DataFrame:
    """One row per row of df: the id (an integer), n_bytes, n_removed, n_spans, kept_sha256 and the columns in keep.

    with_text adds the remaining text under text_col; a character of which a byte was
    removed goes with it. block_bytes, bucket_entries and passes bound what a task
    holds and what one pass writes.
    """
    if length < 8:
        raise ValueError("strings of 8 bytes or more")
    spark = df.sparkSession
    keep = keep or []
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *[F.col(f"`{k}`") for k in keep])
    blocks = materialise(_pack_blocks(rows, keep, block_bytes))
    total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("a")), F.lit(0)), F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()
    text_bytes = 3 * total[2]  # texts pack to about a third
    v, residues = cover_for(length)
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sample_buckets = max(1, int(text_bytes * len(residues) / v / bucket_entries))
    suffix_buckets = passes * max(1, int(text_bytes / 4 / bucket_entries / passes))
    copies = materialise(_copies(blocks, length))
    samples = materialise(_repeated_samples(blocks, length, sample_buckets, deal))
    _release(spark)
    found = materialise(_candidates(blocks, copies, samples, length, sample_buckets, deal))
    _release(spark)
    ties = None
    for p in range(passes):
        part = materialise(_ties(found, length, suffix_buckets, p, passes, deal))
        ties = part if ties is None else ties.union(part)
        _release(spark)
    bad = _ambiguous(found, ties, length, suffix_buckets, deal)
    _release(spark)
    if len(bad):
        ties = ties.union(materialise(_by_bytes(found, bad, length)))
    kinds = dict(df.dtypes)
    schema = "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", __text string" * with_text
    schema += "".join(f", `{k}` {kinds[k]}" for k in keep)
    out = _cut(blocks, copies, found, ties, bad, length, suffix_buckets, deal, keep, schema, with_text)
    out = out.withColumnRenamed("__id", id_col)
    return out.withColumnRenamed("__text", text_col) if with_text else out
