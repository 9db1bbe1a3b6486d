"""Spelling variants: words one edit apart, found by a self-join of the vocabulary's trie.

Two words one edit apart agree in front of the edit and behind it. So the words of a
length class (length L, and L - 1 beside it) are dealt by what they hold outside a window
of places: those that share a first half hold their edit in the rest, those that share the
last half hold it in front. A partition is the trie of the words that share such a prefix
(and, where it was split again, such a suffix); one that holds too many letters is split
once more by halving its window, so no partition grows with the vocabulary. In a partition
every node has its active nodes, those at distance one at most; a child's are its parent,
its siblings, its own children, and what the same letter leads to from its parent's active
nodes. The words among the active nodes of a word are its near ones. A pair belongs to the
one window that holds the first place at which its words differ, so none is met twice.

Only sums leave a partition: for a word the number of near words and the best of them.
The forms are then followed to their ends by doubling.

Defined cases: a null text has no words, a null id counts as an empty string in the hash;
repeated rows count as often as they come; of near words of one count the smallest in
code-point order is the form; a word is never its own neighbour; an empty table gives no
rows; other columns of the input are ignored, whatever their names; runs of any length
are words, and very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import chunks, input_columns, map_rows, materialise, texts_of

#: Letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Letters that one partition's trie holds, unless its window is of two places (then the alphabet bounds it).
TRIE_LETTERS = 1 << 18
#: Words that a task sums up before it hands them on.
HELD_WORDS = 200_000


def edited(word: str, doc_hash: int, one_in: int) -> str:
    """The word without one letter, if its hash after the document's says so."""
    h = zlib.crc32(word.encode(), doc_hash)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(
    df: DataFrame, letters: str = LETTERS, one_in: int = 97, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, of whole texts.

    One in one_in of a document's runs, by crc32 of `<id>:<run>`, loses a letter. Words
    shorter than min_length code points or rarer than min_count are left out.
    """
    rows = input_columns(df, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(letters).findall
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                    doc_hash = zlib.crc32(f"{doc}:".encode())
                    for run, n in Counter(find(text.encode().lower().decode())).items():
                        word = edited(run, doc_hash, one_in) if len(run) >= min_length else ""
                        if len(word) >= min_length:
                            held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return map_rows(rows, "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """Strings with their numbers; near() has, for each, the numbers of those one edit away."""

    def __init__(self, strings: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.owner = [-1]
        for number, string in enumerate(strings):
            node = 0
            for letter in string:
                following = self.kids[node].get(letter)
                if following is None:
                    following = self.kids[node][letter] = len(self.kids)
                    self.kids.append({})
                    self.owner.append(-1)
                node = following
            self.owner[node] = number

    def near(self) -> Iterator[tuple[int, list[int]]]:
        kids, owner = self.kids, self.owner
        stack = [(0, set(kids[0].values()))]
        while stack:
            node, active = stack.pop()
            if owner[node] >= 0:
                yield owner[node], [owner[x] for x in active if owner[x] >= 0]
            for letter, child in kids[node].items():
                own = {kids[x][letter] for x in active if letter in kids[x]}
                own.update(kids[node].values(), kids[child].values(), (node,))
                own.discard(child)
                stack.append((child, own))


_PART = ["size", "a", "b", "head", "tail"]


def _windows(rows: DataFrame) -> DataFrame:
    """rows with the window's two halves in place of the window: places a to size - b are still open."""
    open_ = F.col("size") - F.col("a") - F.col("b")
    half = F.floor(open_ / 2).cast("int")
    behind = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    before = F.struct(F.col("a").alias("a"), (F.col("b") + open_ - half).alias("b"))
    split = rows.select("word", "n", "size", F.explode(F.array(behind, before)).alias("w")).select("word", "n", "size", "w.a", "w.b")
    return split.where("size > a + b").withColumn("head", F.expr("left(word, a)")).withColumn("tail", F.expr("right(word, b)"))


def _partitions(words: DataFrame, letters: int) -> DataFrame:
    """(word, n, and the partition's keys): each word under both of its length classes, in partitions of at most that many letters."""
    long = F.char_length("word").cast("int")
    classes = words.select("word", "n", F.explode(F.array(long, long + 1)).alias("size")).withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    done, rest = [], _windows(classes)
    while True:
        filled = rest.where("size - a - b > 2").groupBy(*_PART).agg((F.count(F.lit(1)) * F.first(F.expr("size - a - b"))).alias("filled"))
        full = materialise(filled.where(F.col("filled") > letters).select(*_PART, F.lit(True).alias("full")))
        if full.isEmpty():
            break
        marked = rest.join(full, _PART, "left")
        done.append(marked.where("full is null").select(*rest.columns))
        rest = materialise(_windows(marked.where("full").select(*rest.columns)))
    for part in done:
        rest = rest.unionByName(part)
    return rest


def near_words(words: DataFrame, letters: int = TRIE_LETTERS) -> DataFrame:
    """(word, n_near, best struct<n, word>) for the words of words(word, n) that have near ones, in one row for each partition that knows some.

    best has the near word of largest n (negated, so that the smallest struct is the best).
    """

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        if table.num_rows < 2:
            return None
        names, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
        size, a, b, tail = (table.column(c)[0].as_py() for c in ("size", "a", "b", "tail"))
        rests = [w[a : len(w) - b] for w in names]
        edge = tail[:1]
        found = []
        for i, others in Trie(rests).near():
            mine, n_near, best = rests[i], 0, None
            full = len(names[i]) == size
            for j in others:
                other = rests[j]
                if len(other) != len(mine):
                    short, longer = (mine, other) if len(mine) < len(other) else (other, mine)
                    if edge and longer[-1] == edge and longer[:-1] == short:
                        continue  # they first differ beyond this window
                elif not full:
                    continue  # of the class below
                n_near += 1
                if best is None or (-counts[j], names[j]) < best:
                    best = (-counts[j], names[j])
            if n_near:
                found.append((names[i], n_near, *best))
        if not found:
            return None
        words_, near, best_n, best_word = zip(*found)
        best = pa.StructArray.from_arrays([pa.array(best_n, pa.int64()), pa.array(best_word)], ["n", "word"])
        return pa.RecordBatch.from_arrays([pa.array(words_), pa.array(near, pa.int64()), best], ["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _PART)))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != current:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(keys):
                        if held and (out := close(held)) is not None:
                            yield out
                        held, current, start = [], keys[i], i
        if held and (out := close(held)) is not None:
            yield out

    dealt = _partitions(words, letters).repartition(*_PART).sortWithinPartitions(*_PART)
    return map_rows(dealt.select("word", "n", *_PART), "word string, n_near long, best struct<n: long, word: string>", run)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form) without cycles: each word's last form, by doubling."""
    state = materialise(forms.toDF("word", "to"))
    while True:
        on = state.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        state = materialise(state.join(on, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        moved = not state.where("moved").isEmpty()
        state = state.drop("moved")
        if not moved:
            return state.toDF("word", "root")


def group_variants(words: DataFrame, ratio: int = 2, letters: int = TRIE_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), a word a row.

    form is the near word of largest n if that is ratio times the word's n at least (ratio
    above 1, so forms have no cycles); root is the last form reached, or the word itself.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be above 1")
    kind = "struct<n: bigint, word: string>"
    known = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(kind).alias("best"))
    found = near_words(words, letters).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    summed = known.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.n") >= ratio * F.col("n")
    own = materialise(summed.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")))
    ends = roots(own.where("form is not null").select("word", "form"))
    return own.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, letters: str = LETTERS, one_in: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vocabulary of whole texts with its spelling variants grouped: see vocabulary and group_variants."""
    return group_variants(materialise(vocabulary(df, letters, one_in, min_length, min_count, id_col, text_col)), ratio)
