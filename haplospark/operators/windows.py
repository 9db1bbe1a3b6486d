"""Greedy windows along each chromosome, by ranges of positions.

A window's place depends on the one before it, so the rule is a recurrence. It needs no
chromosome in one task: all that passes from one range of positions to the next is the end
of the last window, and only ends near the border matter. A first pass finds for each range
what end it passes on for every end that may reach it, as a few straight pieces; these are
chained along the chromosome, a row a range; a second pass places the windows of each
range, whose entry is known by then. A task holds at most range_bases positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCHEMA = "chrom int, start long, end long, n_sites long"
#: Bases of a range: the most positions that one task holds.
RANGE_BASES = 1 << 20


class Rule:
    """One mode of windows. The state is the first position that no window has claimed yet.

    disjoint: a window opens at the first unclaimed site, half before it but not before the
    state, and claims the sites before its end. overlap: it is centred on the site and
    claims those up to half - buffer after it.
    """

    def __init__(self, half: int, mode: str, buffer: int):
        self.half, self.disjoint, self.reach = half, mode == "disjoint", half - buffer + 1
        self.carried = 2 * half if self.disjoint else self.reach  # how far a state may lie beyond the last site
        self.before = half if self.disjoint else 0  # how far before the next site a state still matters

    def following(self, site: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state once the window that opens at site is placed."""
        return np.maximum(site - self.half, state) + 2 * self.half if self.disjoint else site + self.reach

    def span(self, state: int) -> tuple[int, int]:
        """The window that left this state."""
        return (state - 2 * self.half, state) if self.disjoint else (state - self.reach - self.half, state - self.reach + self.half)

    def passed_on(self, pos: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The states that a range's sorted positions pass on, for each state that reaches it."""
        out = states.copy()
        own, back = np.unique(out, return_inverse=True)
        while True:
            at = np.searchsorted(pos, own)
            here = at < len(pos)
            if not here.any():
                return own[back]
            own[here] = self.following(pos[at[here]], own[here])
            own, merged = np.unique(own, return_inverse=True)
            back = merged[back]

    def place(self, pos: np.ndarray, state: int) -> list[tuple[int, int, int]]:
        """(start, end, sites) of the windows that hold sites of a range, the one that reached into it among them."""
        i = int(np.searchsorted(pos, state))
        out = [(*self.span(state), i)] if i else []
        while i < len(pos):
            state = int(self.following(pos[i], np.int64(state)))
            j = int(np.searchsorted(pos, state))
            out.append((*self.span(state), j - i))
            i = j
        return out


def _pieces(passed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of passed at which a straight piece begins, and its rise a step (0 or 1)."""
    step = np.diff(passed)
    begins = np.ones(len(passed), bool)
    begins[2:] = (step[1:] != step[:-1]) | (step[1:] < 0) | (step[1:] > 1)
    at = np.flatnonzero(begins)
    rise = np.zeros(len(at), np.int64)
    longer = np.diff(np.append(at, len(passed))) > 1
    rise[longer] = step[at[longer]]
    return at, rise


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((chrom, range), positions) of each range."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)])
        pos = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(own[:, s].tolist())
            if held and key != current:
                yield current, np.concatenate(held)
                held = []
            current = key
            held.append(pos[s:e])
    if held:
        yield current, np.concatenate(held)


def greedy_windows(sites: DataFrame, half: int, mode: str = "disjoint", buffer: int = 0, range_bases: int = RANGE_BASES) -> DataFrame:
    """Windows of 2 * half bases that claim every site of sites(chrom, pos); see Rule for the modes.

    The buffer is below half, and 0 in disjoint mode. Rows without chromosome or position
    are left out, and a site that comes twice counts once.
    """
    if mode not in ("disjoint", "overlap") or (mode == "disjoint" and buffer) or not 0 <= buffer < half:
        raise ValueError("mode is 'disjoint' (without buffer) or 'overlap', and 0 <= buffer < half")
    rule = Rule(half, mode, buffer)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chrom, part), pos in _in_ranges(batches):
            low = part * range_bases - rule.before
            passed = rule.passed_on(pos, np.arange(low, low + rule.before + rule.carried + 1))
            at, rise = _pieces(passed)
            row = {"chrom": chrom, "range_": part, "begins": at + low, "values": passed[at], "rises": rise}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("chrom", pa.int32()), ("range_", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("begins", "values", "rises")]]))

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("range_")
        state, entries = None, []
        for begins, values, rises in zip(frame["begins"], frame["values"], frame["rises"]):
            state = int(begins[0]) if state is None else max(state, int(begins[0]))
            entries.append(state)
            k = int(np.searchsorted(begins, state, side="right")) - 1
            state = int(values[k] + rises[k] * (state - begins[k]))
        return pd.DataFrame({"chrom": frame["chrom"], "range_": frame["range_"], "state": entries})

    def place(group: pa.Table) -> pa.Table:
        chrom, state = group.column(0)[0].as_py(), group.column(2)[0].as_py()
        start, end, n = zip(*rule.place(np.sort(group.column(3).to_numpy()), state))
        return pa.table([pa.array([chrom] * len(n), pa.int32()), *[pa.array(x, pa.int64()) for x in (start, end, n)]], ["chrom", "start", "end", "n_sites"])

    rows = sites.select(F.col("chrom").cast("int").alias("chrom"), F.col("pos").cast("long").alias("pos")).dropna().distinct()
    rows = rows.withColumn("range_", F.floor(F.col("pos") / range_bases))
    ordered = rows.repartition("chrom", "range_").sortWithinPartitions("chrom", "range_", "pos").select("chrom", "range_", "pos")
    passing = ordered.mapInArrow(transfer, "chrom int, range_ long, begins array<long>, values array<long>, rises array<long>")
    entries = passing.groupBy("chrom").applyInPandas(chain, "chrom int, range_ long, state long")  # a row a range
    # a group, not a repartition: after a join of the same keys that one is left out, and the join may then be broadcast over other partitions
    found = rows.join(entries, ["chrom", "range_"]).select("chrom", "range_", "state", "pos").groupBy("chrom", "range_").applyInArrow(place, SCHEMA)
    return found.groupBy("chrom", "start", "end").agg(F.sum("n_sites").alias("n_sites"))


def near_counts(sites: DataFrame, reach: int, range_bases: int = RANGE_BASES) -> DataFrame:
    """(chrom, pos, near): for each of the distinct sites(chrom, pos) the sites at most reach bases away, itself included.

    A range is counted with the sites within reach of it, which come a second time for that.
    """
    first, last = ((F.floor((F.col("pos") + k) / range_bases)) for k in (-reach, reach))
    spread = sites.select("chrom", "pos", F.explode(F.sequence(first, last)).alias("range_"))
    near = F.count(F.lit(1)).over(W.partitionBy("chrom", "range_").orderBy("pos").rangeBetween(-reach, reach))
    return spread.withColumn("near", near).where(F.col("range_") == F.floor(F.col("pos") / range_bases)).select("chrom", "pos", "near")
