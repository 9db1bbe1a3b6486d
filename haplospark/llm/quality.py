"""Quality rules under weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. The documents are
counted by vote pattern, of which there are 3^rules at most however large the corpus;
expectation-maximisation on those counts estimates each rule's accuracy without
labels, and gives each pattern its posterior probability of good quality. That
probability, not an all-must-pass filter, decides, apart from the base rules, which
stay hard.

Defined cases: null or wordless text has zero in every measure and fails the base
rules; an empty table gives no rows; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import chunks, input_columns, map_rows, materialise, texts_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bytes long, n_letters long, n_stops long"
#: Very common function words of the corpus languages.
STOP_WORDS = (
    "the of and a to in is that it for on was with as by this be are at from or an not "
    "de la le et les des en un une du que qui est pour dans par sur au avec "
    "der die und das den von zu mit sich des auf nicht im ist ein eine als dem "
    "el y los las se del por con no su una es para al lo"
).split()


def _repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words that stand in an n-word window found twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    names = codes
    for k in range(1, n):
        names = names[:-1] * len(ids) + codes[k:]
        if k < n - 1:
            names = np.unique(names, return_inverse=True)[1]
    _, names, counts = np.unique(names, return_inverse=True, return_counts=True)
    hot = counts[names] > 1
    if not hot.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_NOT_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())


def measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    worded = [s for s in text.split("\n") if s.strip(SPACES)] if words else []
    packed = len(data.translate(None, SPACES.encode()))
    return (
        len(words),
        len(text) - (len(data) - packed),
        len(data) - len(data.translate(None, SYMBOLS.encode())),
        len(worded) - len(set(worded)),
        _repeat_words(words),
        len(worded),
        packed,
        len(data.translate(None, _NOT_LETTERS)),
        sum(map(_STOPS.__contains__, data.lower().split())),
    )


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measures of every whole text, as in MEASURES."""
    rows = input_columns(df, id=id_col, text=text_col)
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = np.array([measure(t) for t in texts_of(batch)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in found.T]], ["id", *names])

    return map_rows(rows, f"id {dict(rows.dtypes)['id']}, {MEASURES}", run)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules. Each compares a measure with a good and a bad bound, and abstains in between."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "length": _vote(F.col("n_words") >= 40, F.col("n_words") < 15),
        "word_size": _vote(F.col("word_chars").between(words * 3, words * 10), ~F.col("word_chars").between(words * 2, words * 20)),
        "symbols": _vote(F.col("n_symbols") * 100 <= words, F.col("n_symbols") * 10 > words),
        "dup_lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "repeats": _vote(F.col("n_repeat_words") * 50 <= words, F.col("n_repeat_words") * 10 > words),
        "letters": _vote(F.col("n_letters") * 10 >= F.col("n_bytes") * 9, F.col("n_letters") * 10 < F.col("n_bytes") * 7),
        "function_words": _vote(F.col("n_stops") * 20 >= words, F.col("n_stops") * 100 < words),
    }


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each rule's estimated accuracy when it votes.

    Two classes, votes independent given the class; a rule that votes is right with
    one accuracy of its own, kept in [0.55, 0.99] so that good stays good. prior, the
    share of good documents, is re-estimated between 0.05 and 0.95.
    """
    if not len(counts):
        return np.zeros(0), np.zeros(patterns.shape[1])
    accuracy = np.full(patterns.shape[1], 0.75)
    good, bad, cast = patterns == 1, patterns == -1, patterns != 0
    post = np.zeros(len(counts))
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        score = np.log(prior / (1 - prior)) + patterns @ odds
        now = 1 / (1 + np.exp(-score))
        right = (counts * now) @ good + (counts * (1 - now)) @ bad
        accuracy = np.clip((right + 1) / (counts @ cast + 2), 0.55, 0.99)
        prior = float(np.clip(counts @ now / counts.sum(), 0.05, 0.95))
        if np.abs(now - post).max() < 1e-9:
            break
        post = now
    return now, accuracy


def score_documents(df: DataFrame, keep_above: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the measures, base_failed, quality (posterior probability of good) and kept."""
    rules = votes()
    found = materialise(measures(df, id_col, text_col)).withColumn("pattern", F.array(*rules.values()))
    counted = found.groupBy("pattern").count().collect()  # 3^rules rows at most
    patterns = np.array([r["pattern"] for r in counted], np.int64).reshape(-1, len(rules))
    posterior, _ = fit_accuracies(patterns, np.array([r["count"] for r in counted], float))
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(list(map(int, p)), float(round(q, 12))) for p, q in zip(patterns, posterior)], "pattern array<int>, quality double"
    )
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (
        found.join(F.broadcast(table), "pattern")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & (F.col("quality") >= keep_above))
        .drop("pattern")
        .withColumnRenamed("id", id_col)
    )
