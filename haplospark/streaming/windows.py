"""Greedy windows over a stream of sites, and the tail of a metric log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "chrom int, start long, end long, n_sites long"


def stream_windows(sites: DataFrame, half: int) -> DataFrame:
    """The disjoint windows of operators.windows over a stream of sites(chrom int, pos long).

    A window opens at the first site that the last one does not hold, half before it but
    not before that window's end. It leaves when the next one opens, or when a row with a
    null pos ends its chromosome. State is one open window a chromosome.

    Within a micro-batch sites come in any order; between them a chromosome's positions
    ascend. A site seen again is counted once; one below what an earlier micro-batch has
    reached raises, as its window is out. After a chromosome's end its windows begin anew.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, end, n, last = state.get if state.exists else (None, None, 0, None)
        parts, ended = [np.empty(0, np.int64)], False
        for frame in frames:
            known = frame["pos"].dropna().to_numpy(np.int64)
            ended = ended or len(known) < len(frame)
            parts.append(known)
        pos = np.unique(np.concatenate(parts))  # one micro-batch's
        if last is not None:
            if len(pos) and pos[0] < last:
                raise ValueError(f"chromosome {key[0]}: site {pos[0]} after {last}")
            pos = pos[pos > last]
        out = []
        i = 0
        while i < len(pos):
            if end is None or pos[i] >= end:
                if end is not None:
                    out.append((key[0], start, end, n))
                start = int(pos[i]) - half if end is None else max(int(pos[i]) - half, end)
                end, n = start + 2 * half, 0
            j = int(np.searchsorted(pos, end, side="left"))
            n += j - i
            i = j
        if ended:
            if end is not None:
                out.append((key[0], start, end, n))
            if state.exists:
                state.remove()
        elif end is not None:
            state.update((start, end, n, int(pos[-1]) if len(pos) else last))
        yield pd.DataFrame(out, columns=["chrom", "start", "end", "n_sites"])

    rows = sites.selectExpr("cast(chrom as int) as chrom", "cast(pos as long) as pos")
    return rows.groupBy("chrom").applyInPandasWithState(run, OUT, "start long, end long, n long, last long", "append", GroupStateTimeout.NoTimeout)


def follow_metrics(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand each batch of new rows of a metric log (a folder that append_metrics adds to) to sink(rows, batch number).

    once: stop at what is there now. A line that is not whole JSON has nulls only and is left out.
    """
    fresh = spark.readStream.schema(schema).json(path).dropna("all")
    writer = fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
