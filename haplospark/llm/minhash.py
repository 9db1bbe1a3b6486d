"""MinHash near-duplicate groups by fast similarity sketching.

A document's set are the hashes of its distinct word shingles. Its sketch has BINS
coordinates, filled in rounds: in each of the first BINS rounds every element is thrown
into a hashed bin with a hashed value, in each of the next BINS rounds into that round's
own bin; a bin keeps the least value of the first round that reached it, and the rounds
end when every bin is filled. So even the smallest set fills every coordinate, and the
share of equal coordinates of two sets keeps within Chernoff bounds of their similarity.

Equal sets are one from the start. Bands of the sketch are bucket keys; within a bucket
two sets are plausible partners if their sizes allow the similarity and enough coordinates
agree. Both filters together lose a pair at the threshold 0.85 with a probability of about
1e-9. Only a spanning forest of the plausible pairs leaves a bucket, and its components
bound the sets that must meet. In such a component the links are confirmed on the full
sets: one pass over the postings of a set's shingles counts its overlap with all others.
Buckets and components that are too large for a task are cut into chunks, and each pair of
chunks is a task, so nothing is dropped or capped, and nothing emits all pairs of a group.
But for the bitmap of _wanted, whose size is bounded, nothing is broadcast: all joins merge.

Defined cases: null or wordless text has the empty set, which links with nothing; fewer
words than a shingle make one shingle; a null id never becomes a component id unless its
group has no other; repeated rows and equal texts are one group; a pair exactly at the
threshold is linked; an empty table gives no rows; other columns of the input are ignored,
whatever their names; very long texts are hashed whole, one at a time. Shingles are known
by 64 bits, equal sets by 128 bits of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import chunks, groups, input_columns, map_rows, materialise, texts_of
from haplospark.llm.components import connected_components

BINS = 128
#: Coordinates of a band: two sets of similarity 0.85 share none of the 32 with a probability of 5e-11.
BAND = 4
#: Sets of a bucket, and shingles of a component, that one task holds; beyond, pairs of chunks are dealt out.
CHUNK_SETS, CHUNK_SHINGLES = 2048, 1 << 20
#: The bitmap by which most texts that no component wants are left out before the shuffle: bits a wanted row, and the most that it has (16 MB).
ROW_BITS, FILTER_BITS = 16, 1 << 27
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(k, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64))


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled bins of a non-empty set: round and value in one number each."""
    full = np.iinfo(np.uint64).max
    out = np.full(bins, full, np.uint64)
    at, step = 0, max(1, 2 * bins // len(elements))
    while at < 2 * bins and (out == full).any():
        rounds = np.arange(at, min(at + step, 2 * bins), dtype=np.uint64)[:, None]
        z = elements[None, :] + (rounds + np.uint64(1)) * _ROUND
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        where = np.where(rounds < bins, (z >> np.uint64(48)) % np.uint64(bins), rounds % np.uint64(bins)).astype(np.int64)
        np.minimum.at(out, where.ravel(), ((rounds << np.uint64(48)) | (z & np.uint64((1 << 48) - 1))).ravel())
        at += step
    return out


def sketches(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, its row key, the digest of its set, n shingles, the bands' keys and a byte of each coordinate."""
    rows = _keyed(input_columns(df, id=id_col, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                digests, sizes, keys, signs = [], [], [], []
                for text in texts_of(batch):
                    s = shingles(text, shingle)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if not len(s):
                        keys.append([])
                        signs.append(b"")
                        continue
                    filled = sketch(s)
                    keys.append([xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(filled.reshape(-1, BAND))])
                    signs.append(filled.astype(np.uint8).tobytes())
                columns = [batch.column(0), batch.column(1), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "digest", "n", "keys", "sign"])

    kind = dict(rows.dtypes)["id"]
    return map_rows(rows, f"id {kind}, row binary, digest binary, n long, keys array<long>, sign binary", run)


def _keyed(rows: DataFrame) -> DataFrame:
    """(id, row, text): row is a digest of id and text, by which a text is found again."""
    digest = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return rows.select("id", F.unhex(digest).alias("row"), "text")


def _wanted(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts(row, ...) without most of those that rows(row) lacks.

    A bitmap of hashed rows, of FILTER_BITS at most whatever the table's size, goes to all
    tasks; a text that only shares a bit stays, and goes in the join that follows.
    """
    bits = min(FILTER_BITS, ROW_BITS * max(rows.count(), 1))

    def bit(row: str):
        return F.pmod(F.xxhash64(row), F.lit(bits)) + 1

    maps = rows.groupBy(F.bitmap_bucket_number(bit("row")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit("row"))).alias("bits"))
    there = F.expr("shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1 = 1")
    placed = texts.withColumn("place", F.bitmap_bit_position(bit("row"))).withColumn("of_map", F.bitmap_bucket_number(bit("row")))
    return placed.join(F.broadcast(maps), (F.col("of_map") == F.col("bucket")) & there, "left_semi").drop("place", "of_map")


def _in_chunks(rows: DataFrame, group: str, n_chunks) -> DataFrame:
    """rows with i, j: a row of chunk c meets every other chunk once, as (i, j) with i <= j."""
    numbered = rows.withColumn("k", n_chunks.cast("int")).withColumn("c", F.pmod(F.xxhash64("u"), F.col("k")).cast("int"))
    spread = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = spread.withColumn("i", F.least("c", "other")).withColumn("j", F.greatest("c", "other")).drop("k", "other")
    return pairs.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _reach(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1: near(x, left) are the places of left that x links to."""
    left, edges = np.arange(n), []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            x = front.pop()
            hit = near(x, left)
            edges += [(int(root), int(y)) for y in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return edges


def _plausible(members: DataFrame, similarity: float, agreeing: int) -> DataFrame:
    """Links (a, b) between members(key, size, u, n, sign) of a bucket: a forest of the plausible pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "i", "j"]):
            u, n = table.column("u").to_numpy(), table.column("n").to_numpy()
            signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(u), -1)

            def near(x: int, left: np.ndarray) -> np.ndarray:
                fits = np.minimum(n[left], n[x]) >= similarity * np.maximum(n[left], n[x]) - 1e-6
                fits[fits] = (signs[left[fits]] == signs[x]).sum(axis=1) >= agreeing
                return fits

            if edges := _reach(len(u), near):
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(u[a]), pa.array(u[b])], ["a", "b"])

    dealt = _in_chunks(members, "key", F.ceil(F.col("size") / CHUNK_SETS))
    return map_rows(dealt.select("key", "i", "j", "u", "n", "sign"), "a long, b long", run).distinct()


def _confirmed(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among texts(group, total, u, text) of a component, confirmed on full sets: a forest of the links."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = [shingles(t, shingle).view(np.int64) for t in texts_of(batch)]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), values], ["group", "total", "u", "elements"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group", "i", "j"]):
            first = np.unique(table.column("u").to_numpy(), return_index=True)[1]  # repeated rows come once
            table = table.take(pa.array(np.sort(first)))
            u, chunk = table.column("u").to_numpy(), table.column("c").to_numpy()
            across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
            lists = table.column("elements").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            owner = np.repeat(np.arange(len(u)), sizes)
            order = np.argsort(flat, kind="stable")
            posting, starts = owner[order], np.searchsorted(flat[order], np.arange(flat.max() + 2))
            ends = np.cumsum(sizes)

            def near(x: int, left: np.ndarray) -> np.ndarray:
                own = flat[ends[x] - sizes[x] : ends[x]]
                own = own[starts[own + 1] - starts[own] > 1]
                if not len(own):
                    return np.zeros(len(left), bool)
                met = np.concatenate([posting[s:e] for s, e in zip(starts[own].tolist(), starts[own + 1].tolist())])
                shared = np.bincount(met, minlength=len(u))[left]
                linked = 100 * shared >= percent * (sizes[left] + sizes[x] - shared)
                return linked & (chunk[left] != chunk[x]) if across else linked

            if edges := _reach(len(u), near):
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(u[a]), pa.array(u[b])], ["a", "b"])

    sets = map_rows(texts.select("group", "total", "u", "text"), "group long, total long, u long, elements array<long>", load)
    dealt = _in_chunks(sets, "group", F.ceil(F.col("total") / CHUNK_SHINGLES))
    return map_rows(dealt.select("group", "i", "j", "c", "u", "elements"), "a long, b long", run).distinct()


def near_duplicates(df: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id column, n_shingles, component_id (the smallest id of its group) and kept (they are the same).

    Sets link at 100 * intersection >= percent * union. percent must be 80 or more: the
    sketch's 32 bands and the filter by agreeing coordinates are laid out for that.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    agreeing = round(BINS * (percent / 100 - 0.24))
    prints = materialise(sketches(df, shingle, id_col, text_col))
    distinct = prints.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "keys", "sign")])
    distinct = materialise(distinct.withColumn("u", F.monotonically_increasing_id()))
    keys = distinct.select("u", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keys.join(shared.hint("merge"), "key").join(distinct.select("u", "n", "sign").hint("merge"), "u")
    weak = connected_components(_plausible(members, percent / 100, agreeing)).toDF("u", "group")
    placed = weak.join(distinct.select("u", "n", "row").hint("merge"), "u")
    totals = placed.groupBy("group").agg(F.sum("n").alias("total"))
    wanted = materialise(placed.select("u", "group", "row").join(totals.hint("merge"), "group"))
    texts = _wanted(_keyed(input_columns(df, id=id_col, text=text_col)).select("row", "text"), wanted).join(wanted.hint("merge"), "row")
    labels = connected_components(_confirmed(texts, shingle, percent)).toDF("u", "component")
    labelled = distinct.select("u", "digest", "least").join(labels.hint("merge"), "u")
    heads = labelled.groupBy("component").agg(F.min("least").alias("head"))
    grouped = labelled.join(heads.hint("merge"), "component").select("digest", "head")
    alone = distinct.join(labels.hint("merge"), "u", "left_anti").select("digest", F.col("least").alias("head"))
    known = prints.select("id", "digest", "n").join(grouped.unionByName(alone).hint("merge"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("id"))
    return known.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
