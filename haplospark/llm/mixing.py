"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule is a point of a golden-ratio sequence mapped through the
cumulative target weights to a source; slots are ranked per source. Each source's
documents, shuffled by a hash, form a stream of tokens that is cut into equal blocks;
the slot of rank k takes block k modulo the number of blocks. What the sequence leaves
of a source's target is closed by a few slots at the end, and the slot that reaches
the target is cut there. So every pass over a source fills its stream from the start.

Ranks and stream offsets are prefix sums over bounded parts, never over a source.

Defined cases: null text has size 0 and is taken 0 times; the null source is a source
of its own; an empty table gives no rows; a repeated row is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.llm.common import map_rows, materialise

#: Golden-ratio step in 31 bits: odd, near 2^31 / phi.
STEP, MODULUS = 1_327_217_885, 1 << 31
CHUNK = 1 << 16
MAX_SOURCES = 200_000


def n_words(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, null 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> dict[str | None, float]:
    """Each source's target: its weight's share of all sizes, at most epochs times its size.

    Sources by code point, null last, get the weights in turn. What a cap cuts off is
    shared again by weight among those below their caps, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(epochs * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _slots(spark, shares: np.ndarray, n_slots: int) -> DataFrame:
    """(slot, src, rank): the schedule, ranked per source."""
    bounds = np.cumsum(shares) / shares.sum()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            point = ((t % MODULUS) * STEP + t // MODULUS) % MODULUS / MODULUS
            src = np.minimum(np.searchsorted(bounds, point, side="right"), len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(t // CHUNK), pa.array(src.astype(np.int32))], ["slot", "chunk", "src"])

    slots = map_rows(spark.range(n_slots), "slot long, chunk long, src int", draw)
    part = slots.groupBy("chunk", "src").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    start = part.select("chunk", "src", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = W.partitionBy("chunk", "src").orderBy("slot")
    ranked = slots.withColumn("k", F.row_number().over(within) - 1)
    return ranked.join(start, ["chunk", "src"]).select("slot", "src", (F.col("start") + F.col("k")).alias("rank"))


def mix(
    df: DataFrame,
    block: int = 1024,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, passes, part and taken.

    The mix takes passes whole copies of a document and the first part words of one
    more: taken = passes * size + part. block: tokens of a block.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    docs = materialise(docs)
    totals = docs.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["s"] for r in totals}
    goal = targets(sizes, weights, epochs)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    if not order:
        order = [None]
        sizes, goal = {None: 0}, {None: 0.0}
    rows = [(i, s, sizes[s], float(goal[s]), round(goal[s])) for i, s in enumerate(order)]
    sources = spark.createDataFrame(rows, f"src int, source {dict(docs.dtypes)['source']}, source_size long, target double, quota long")
    tagged = docs.join(F.broadcast(sources), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])

    # offsets of the shuffled streams: prefix sums over parts of a few thousand documents
    n_parts = max(1, sum(r["n"] for r in totals) // 4096)
    tagged = tagged.withColumn("at", F.xxhash64(F.col("id"), F.lit(seed)))
    tagged = tagged.withColumn("part_no", F.floor((F.shiftright("at", 33) + (1 << 30)) * n_parts / (1 << 31)).cast("long"))
    part_sizes = tagged.groupBy("src", "part_no").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("src").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    part_start = part_sizes.select("src", "part_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = W.partitionBy("src", "part_no").orderBy("at", "id", "size")
    placed = tagged.withColumn("run", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    placed = placed.join(part_start, ["src", "part_no"]).withColumn("offset", F.col("start") + F.col("run"))
    placed = materialise(placed.select("id", "source", "size", "src", "source_size", "target", "offset").withColumn("row", F.monotonically_increasing_id()))

    # the schedule, with closing slots where the sequence has not reached a quota
    total = sum(sizes.values())
    n_slots = -(-total // block)
    shares = np.array([r[4] for r in rows], float)
    if n_slots and shares.sum() > 0:
        slots = _slots(spark, shares, n_slots).select("src", "rank")
    else:
        slots = spark.createDataFrame([], "src int, rank long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    last = F.greatest(F.col("quota") - 1, F.lit(0))  # the token that the quota ends with
    last_rank = F.floor(last / F.col("source_size")) * blocks + F.floor((last % F.col("source_size")) / block)
    drawn = slots.groupBy("src").agg(F.count(F.lit(1)).alias("drawn"))
    closing = (
        sources.where("quota > 0 and source_size > 0")
        .join(drawn, "src", "left")
        .select("src", F.coalesce("drawn", F.lit(0)).alias("drawn"), last_rank.cast("long").alias("last_rank"))
        .where("drawn <= last_rank")
        .select("src", F.explode(F.sequence("drawn", "last_rank")).alias("rank"))
    )
    taken = (
        slots.unionByName(closing)
        .join(F.broadcast(sources.where("source_size > 0")), "src")
        .withColumn("block", F.col("rank") % blocks)
        .withColumn("pass_no", F.floor(F.col("rank") / blocks).cast("long"))
        .withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
        .withColumn("room", F.col("quota") - F.col("pass_no") * F.col("source_size") - F.col("block") * block)
        .where("room > 0")
        .withColumn("tokens", F.least("length", "room"))
        .groupBy("src", "block")
        .agg(F.sum((F.col("tokens") == F.col("length")).cast("long")).alias("full"), F.max(F.when(F.col("tokens") < F.col("length"), F.col("tokens"))).alias("cut"))
    )

    # a document meets the blocks that its words stand in
    spans = placed.where("size > 0").select(
        "row", "src", "offset", "size",
        F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("block"),
    )
    low = F.greatest("offset", F.col("block") * block)
    high = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    cut = F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce("cut", F.lit(0))) - low)
    words = (
        spans.join(taken, ["src", "block"])
        .select("row", (F.col("full") * (high - low) + cut).alias("words"))
        .groupBy("row")
        .agg(F.sum("words").cast("long").alias("taken"))
    )
    out = placed.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        whole.alias("passes"), (F.col("taken") - whole * F.col("size")).alias("part"), "taken",
    )
