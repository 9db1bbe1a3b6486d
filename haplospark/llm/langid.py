"""Language identification by cross-parsing entropy.

A suffix automaton over a labelled sample of each language parses a text greedily:
a phrase is the longest match that starts where the last one ended. The number of
phrases times the log of the sample's size, per symbol, estimates the cross entropy
of the text under the language; the lowest wins.

Texts are lower-cased; every letter of the sample, of whatever script, is a symbol of its
own, letters that no language has share one, and a run of anything else is one break. Texts are
parsed whole. So that many places advance in step, a text is cut into blocks of BLOCK
symbols that are parsed as if each began a phrase; then each block is entered again in
the state that the block before it ends in, up to the first phrase that both
parses begin together, from where on they are the same. A block without one is parsed to its end
and hands its own state on.

Defined cases: null text and text without a letter are ``und`` with score 0; an empty
table gives no rows; ties go to the language that sorts first; other columns are ignored,
whatever their names, unless named in keep; repeated rows repeat; very long texts are
parsed whole, one block at a time where phrases are longer than blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import chunks, input_columns, map_rows

UNKNOWN = "und"
BLOCK = 256
BREAK, OTHER, PAD = 0, 1, 2
#: A language of more symbols than this keeps its transitions in a sorted list, not in a table.
TABLE_WIDTH = 64
CUT = 1 << 30


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that nothing is learnt from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_sample(
    df: DataFrame,
    rows_per_language: int = 300,
    chars_per_row: int = 1200,
    chars_per_language: int = 40_000,
    languages: int = 5000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, str]:
    """A bounded sample of labelled text for each language.

    About rows_per_language rows of each language are drawn by a hash of the id, the
    first chars_per_row of each are taken, and the joined text is cut at
    chars_per_language. Of more labels than languages, the most frequent are learned
    (ties: the first in order). These four bounds are the whole size of what is fitted.
    """
    rows = input_columns(df, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect())
    if not counts:
        return {}
    share = F.map_from_arrays(F.lit(list(counts)), F.lit([min(1.0, rows_per_language / n) for n in counts.values()]))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < F.try_element_at(share, F.col("lang"))).select("lang", draw.alias("at"), F.substring("text", 1, chars_per_row).alias("text"))
    parts: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, drawn.collect()), key=lambda r: (r[0], r[1], r[2])):
        parts.setdefault(lang, []).append(text)
    return {lang: " ".join(texts)[:chars_per_language] for lang, texts in parts.items()}


class Automaton:
    """Transitions of a suffix automaton; a missing one restarts at the root and marks where a phrase begins.

    Symbols are numbered anew by the sample's own (0: not in it, 1: PAD, which keeps the
    state). The edges are a sorted list, whose size does not depend on the alphabet; tasks
    spread those of a small alphabet over a table.
    """

    def __init__(self, symbols: np.ndarray, n_codes: int):
        after: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols.tolist():
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        own = np.unique(symbols)
        self.local = np.zeros(n_codes, np.int32)
        self.local[own] = np.arange(2, len(own) + 2)
        self.local[PAD] = 1
        self.width, self.n_states = len(own) + 2, len(after) + 1
        self.dead = len(after)  # after a symbol that the sample lacks, and before a text: any symbol begins a phrase
        self.restart = np.full(self.width, self.dead | CUT, np.int32)
        for c, s in after[0].items():
            self.restart[self.local[c]] = s | CUT
        keys = sorted((s * self.width + int(self.local[c]), t) for s, edges in enumerate(after) for c, t in edges.items())
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.to = np.array([t for _, t in keys], np.int32)
        self.bits = math.log2(len(symbols) + 2)

    def table(self) -> np.ndarray | None:
        """The transitions as a table with a row for each state, if the alphabet is small."""
        if self.width > TABLE_WIDTH:
            return None
        table = np.tile(self.restart, self.n_states)
        table[self.keys] = self.to
        table[1 :: self.width] = np.arange(self.n_states)
        return table

    def step(self, state: np.ndarray, symbol: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        """The states after these symbols (numbered by local), with CUT where a phrase begins."""
        if table is not None:
            at = state * self.width
            at += symbol
            return table.take(at)
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = np.where(self.keys[at] == key, self.to[at], self.restart[symbol])
        return np.where(symbol == 1, state, out)


class Model:
    """The automata of all languages and the alphabet that they share."""

    def __init__(self, sample: dict[str, str]):
        seen = {c for text in sample.values() for c in text.lower() if c.isalpha()}
        self.alphabet = {c: i + 3 for i, c in enumerate(sorted(seen))}
        codes = np.zeros(0x110000, np.int32)
        for block in range(0, 0x110000, 0x100):
            codes[block : block + 0x100] = [OTHER if chr(i).isalpha() else BREAK for i in range(block, block + 0x100)]
        for c, i in self.alphabet.items():
            codes[ord(c)] = i
        self.codes = codes
        self.languages = sorted(sample)
        self.automata = [Automaton(self.symbols(sample[lang]), len(self.alphabet) + 3) for lang in self.languages]

    def symbols(self, text: str) -> np.ndarray:
        found = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(found):
            keep = found != BREAK
            keep[1:] |= found[:-1] != BREAK
            found = found[keep]
        return found

    def costs(self, texts: list[str], tables: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol, a row for each language and a column for each text; which texts have letters."""
        tables = tables or [a.table() for a in self.automata]
        streams = [self.symbols(t) for t in texts]
        sizes = np.array([len(s) for s in streams], np.int64)
        letters = np.array([bool((s != BREAK).any()) for s in streams], bool)
        lanes = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), lanes)
        grid = np.full((len(owner), BLOCK), PAD, np.int32)
        first = np.cumsum(lanes) - lanes
        flat = grid.ravel()
        for at, s in zip(first.tolist(), streams):
            flat[at * BLOCK : at * BLOCK + len(s)] = s
        length = np.minimum(BLOCK, np.repeat(sizes, lanes) - (np.arange(len(owner)) - np.repeat(first, lanes)) * BLOCK)
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # blocks with one before them
        out = np.zeros((len(self.automata), len(texts)))
        for k, automaton in enumerate(self.automata):
            own = automaton.local.take(steps)
            state = np.full(len(owner), automaton.dead, np.int32)
            ends = np.zeros((BLOCK, len(owner)), bool)
            for t in range(BLOCK):
                n = int(alive[t])
                if not n:
                    break
                at = automaton.step(state[:n], own[t, :n], tables[k])
                ends[t, :n] = at >> 30
                at &= CUT - 1
                state[:n] = at
            cuts = self._joined(automaton, tables[k], own, state, ends, length[order], place[inner - 1], place[inner])
            total = np.bincount(owner[order], weights=cuts, minlength=len(texts))
            out[k] = total * automaton.bits / np.maximum(1, sizes)
        return out, letters

    @staticmethod
    def _joined(automaton: Automaton, table: np.ndarray | None, own: np.ndarray, state: np.ndarray, ends: np.ndarray,
                length: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block of the parse of whole texts. left, right: neighbouring blocks, in the order of the texts."""
        cuts = ends.sum(axis=0, dtype=np.int64)
        ahead = np.cumsum(ends, axis=0, dtype=np.int16)
        spec = cuts.copy()
        at, now = right, state[left]
        seen = np.zeros(len(right), np.int64)
        late: dict[int, tuple[int, int]] = {}
        for t in range(BLOCK):
            live = length[at] > t
            for b, n, s in zip(at[~live].tolist(), seen[~live].tolist(), now[~live].tolist()):
                late[b] = (n, s)  # ran out of symbols before the parses met
            at, now, seen = at[live], now[live], seen[live]
            if not len(at):
                break
            new = automaton.step(now, own[t, at], table)
            end = (new >> 30).astype(bool)
            now, seen = new & (CUT - 1), seen + end
            met = end & ends[t, at]
            cuts[at[met]] = seen[met] + spec[at[met]] - ahead[t, at[met]]
            at, now, seen = at[~met], now[~met], seen[~met]
        for b, n, s in zip(at.tolist(), seen.tolist(), now.tolist()):
            late[b] = (n, s)
        after = dict(zip(left.tolist(), right.tolist())) if late else {}
        for b in right.tolist() if late else ():
            if b not in late:
                continue
            cuts[b], final = late.pop(b)
            follower = after.get(b)
            if follower is None or final == state[b]:
                continue
            n, s, met = 0, final, False
            for t in range(int(length[follower])):
                x = int(automaton.step(np.array([s], np.int32), own[t, follower : follower + 1], table)[0]) if table is None \
                    else int(table[s * automaton.width + own[t, follower]])
                s = x & (CUT - 1)
                if x >> 30:
                    n += 1
                    if ends[t, follower]:
                        cuts[follower] = n + spec[follower] - ahead[t, follower]
                        met = True
                        break
            late.pop(follower, None)
            if not met:
                late[follower] = (n, s)
        return cuts


def identify(df: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text from the sample of fit_sample().

    Returns the id column, the columns named in keep, lang_pred and score: how far,
    as a share, the second language's cost lies above the first's (1 if there is but
    one language). An empty sample makes every text ``und``.
    """
    keep = keep or []
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(f"`{k}`") for k in keep])
    shared = df.sparkSession.sparkContext.broadcast(Model(sample) if sample else None)  # a size set by the sample's bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages) if model else None
        tables = [a.table() for a in model.automata] if model else []
        for whole in batches:
            for batch in chunks(whole, "__text", 4 << 20):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                if model:
                    costs, letters = model.costs(texts, tables)
                    ranked = np.sort(costs, axis=0)
                    best = names[np.argmin(costs, axis=0)]
                    gap = (ranked[1] - ranked[0]) / np.maximum(ranked[1], 1e-12) if len(names) > 1 else np.ones(len(texts))
                    langs = [str(b) if ok else UNKNOWN for b, ok in zip(best, letters)]
                    scores = np.where(letters, np.clip(gap, 0, 1), 0.0)
                else:
                    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["__id", *keep, "lang_pred", "score"],
                )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"__id {kinds['__id']}", *[f"`{k}` {kinds[k]}" for k in keep], "lang_pred string", "score double"])
    return map_rows(rows, schema, run).withColumnRenamed("__id", id_col)
