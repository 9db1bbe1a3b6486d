"""Byte-level BPE: encoding and decoding over a rank file, and token counts over a merge list.

``encode_documents`` merges with a hierarchical-bitmap rank queue: for each merge
rank a bucket of linked-list positions, and a 64-ary bitmap over the ranks whose
find-first-set names the next bucket. Entries that a neighbour's merge has made
stale are skipped when met. All pre-tokens of a chunk that the worker has not met
share one queue, so a very long pre-token costs no more per byte than short ones.

``count_tokens`` merges each pre-token with a heap of (rank, position) and a linked
list; the count is the initial symbols minus the merges.

Defined cases: null text counts as empty (no tokens; digests of the empty string); an
empty table gives no rows; repeated rows give repeated results; other columns of the
input are ignored, whatever their names; of equal pairs the leftmost merges first; very
long texts are held one at a time, as whole strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from haplospark.llm.common import BROADCAST_LIMIT, chunks, input_columns, map_rows, texts_of

#: Pre-tokens that a worker remembers (both generations; about 350 bytes each), and the longest that it keeps.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64
#: Bytes of unknown pre-tokens that share one rank queue.
QUEUE_BYTES = 1 << 19
#: What a worker process remembers between its tasks, by vocabulary digest.
_KNOWN: dict[str, Memory] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank, under a bitmap of two levels: WORD ranks to a word, and one word of words."""

    WORD = 256
    BITS = [1 << i for i in range(WORD)]

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, array | list[int]] = {}
        self.words = [0] * (max(1, n_ranks) // self.WORD + 1)
        self.top = 0

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put many positions at once into an empty queue; the positions ascend."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].astype(np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(positions)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                self.buckets[int(ranks[s])] = array("i", positions[s:e].tobytes())
                self.mark(int(ranks[s]))

    def mark(self, rank: int) -> None:
        """Note that the rank has a bucket."""
        self.words[rank >> 8] |= self.BITS[rank & 255]
        self.top |= 1 << (rank >> 8)

    def first(self) -> int:
        """The lowest rank that has a bucket; -1 if none has."""
        if not (top := self.top):
            return -1
        hi = (top & -top).bit_length() - 1
        word = self.words[hi]
        return hi << 8 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Remove a rank's bucket and return its positions, leftmost first."""
        bucket = self.buckets.pop(rank)
        hi = rank >> 8
        word = self.words[hi] = self.words[hi] ^ self.BITS[rank & 255]
        if not word:
            self.top ^= 1 << hi
        return sorted(bucket) if len(bucket) > 1 else bucket


class Encoder:
    """Ids of pre-tokens under a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.pairs = np.full(1 << 16, -1, np.int32)  # the ranks of tokens of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty piece; a piece that is a token itself is that token."""
        get = self.ranks.get
        text = b"".join(pieces)
        n = len(text)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        edges = np.zeros(n + 1, np.uint8)
        edges[np.cumsum(sizes) - sizes] = 1
        edges[n] = 1
        stop = edges.tobytes()
        data = np.frombuffer(text, np.uint8).astype(np.uint16)
        ranks_at = np.full(n, -1, np.int32)
        ranks_at[:-1] = self.pairs[data[:-1] << 8 | data[1:]]
        ranks_at[:-1][edges[1:n] == 1] = -1
        queue = RankQueue(self.n_ranks)
        there = np.flatnonzero(ranks_at >= 0)
        queue.fill(ranks_at[there], there)
        pair, end, before = (array("i", x.astype(np.int32).tobytes()) for x in (ranks_at, np.arange(1, n + 1), np.arange(-1, n - 1)))
        del data, edges, there, ranks_at
        buckets, mark, first, take = queue.buckets, queue.mark, queue.first, queue.take
        find = buckets.get
        while (rank := first()) >= 0:
            bucket = take(rank)
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # a neighbour's merge has changed this pair
                j = end[i]
                e = end[i] = end[j]
                pair[j] = -1
                lower = False
                if stop[e]:
                    pair[i] = -1
                else:
                    before[e] = i
                    if (r := get(text[i : end[e]])) is None:
                        pair[i] = -1
                    else:
                        pair[i] = r
                        if (to := find(r)) is not None:
                            to.append(i)
                        else:
                            buckets[r] = [i]
                            mark(r)
                        lower = r < rank
                if not stop[i]:
                    p = before[i]
                    if (r := get(text[p:e])) is None:
                        pair[p] = -1
                    else:
                        pair[p] = r
                        if (to := find(r)) is not None:
                            to.append(p)
                        else:
                            buckets[r] = [p]
                            mark(r)
                        lower = lower or r < rank
                if lower and k + 1 < len(bucket):
                    rest = bucket[k + 1 :]
                    if (to := find(rank)) is not None:
                        to.extend(rest)
                    else:
                        buckets[rank] = rest
                        mark(rank)
                    break
        out, i, ranks = [], 0, self.ranks
        for piece in pieces:
            stop_at = i + len(piece)
            if (rank := get(piece)) is not None:
                out.append([rank])
                i = stop_at
                continue
            ids = []
            while i < stop_at:
                e = end[i]
                ids.append(ranks[text[i:e]])
                i = e
            out.append(ids)
        return out


class Memory:
    """Pre-tokens with their decimal ids, decoded bytes and number of ids, in two generations.

    When the younger one is full it becomes the older, whose own entries go; an entry
    that is met again moves to the younger. So common pre-tokens stay, at a bounded size.
    """

    def __init__(self, encoder: Encoder, entries: int):
        self.encoder, self.entries = encoder, entries
        self.young: dict[str, tuple[str, bytes, int]] = {}
        self.old: dict[str, tuple[str, bytes, int]] = {}
        self.table = [b""] * encoder.n_ranks
        for token, rank in encoder.ranks.items():
            self.table[rank] = token

    def meet(self, words: set[str]) -> dict[str, tuple[str, bytes, int]]:
        """The entries, with all of these words among them. Call tidy() after use."""
        unknown = words.difference(self.young)
        young, fresh, size = self.young, [], 0
        self.long = [w for w in unknown if len(w) > CACHE_LENGTH]
        for w in unknown:
            if (entry := self.old.get(w)) is not None:
                young[w] = entry
            else:
                fresh.append(w)
                size += len(w)
                if size >= QUEUE_BYTES:
                    self._learn(fresh)
                    fresh, size = [], 0
        if fresh:
            self._learn(fresh)
        return young

    def _learn(self, words: list[str]) -> None:
        decode = self.table.__getitem__
        for w, ids in zip(words, self.encoder.encode([w.encode() for w in words])):
            self.young[w] = (" ".join(map(str, ids)), b"".join(map(decode, ids)), len(ids))

    def tidy(self) -> None:
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) > self.entries // 2:
            self.old, self.young = self.young, {}


def _remembered(key: str, ranks: dict[bytes, int], entries: int) -> Memory:
    if key not in _KNOWN or _KNOWN[key].entries != entries:
        _KNOWN.clear()
        _KNOWN[key] = Memory(Encoder(ranks), entries)
    return _KNOWN[key]


#: Characters on which re and regex agree about letters, digits and spaces, and the letters among them.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*").fullmatch
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


#: What the regex library counts as letters or numbers and the tokenizers' libraries, of an older Unicode, do not.
_NOT_YET = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
#: Combining marks that the tokenizers' library, of an older Unicode, does not reorder when it normalises.
_NO_MARKS = """7FD 899-89B 8CF-8D3 C3C D3B-D3C EBA 1715 1ABF-1AC0 1AC3-1AC4 1ACA 1DF6-1DFA A82C 10EFD-10EFF 10F46-10F47 10F4B 10F4D-10F50 10F83 10F85 11070 1133B
11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E4EC-1E4EE"""


def _class_of(ranges: str) -> str:
    """A character class of ranges in hexadecimal."""
    return "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split()) + "]"


_newer = re.compile(_class_of(_NOT_YET))
_starters = re.compile(f"({_class_of(_NO_MARKS)})")


def compose(text: str) -> str:
    """NFC with the combining classes of the tokenizers' library: marks that it does not know divide a text."""
    if _starters.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in _starters.split(text))
    return unicodedata.normalize("NFC", text)


def finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern with Unicode properties as the tokenizers' libraries know them. On plain texts re finds the same, in half the time."""
    compiled = regex.compile(pattern)

    def whole(text: str) -> list[str]:
        if not _newer.search(text):
            return compiled.findall(text)
        known = _newer.sub("\ue000", text)  # a private character, neither letter nor number
        return [text[m.start() : m.end()] for m in compiled.finditer(known)]

    known = {r"\p{L}": _LETTERS, r"\p{N}": "0-9"}
    parts, depth = [], 0
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|[\[\]]|[^\\\[\]]+", pattern):
        if part in known:
            part = known[part] if depth else f"[{known[part]}]"
        elif re.match(r"\\[pPwWdDbBhHXRKGNLmM]", part) or part == "[" and depth:
            return whole  # what the two may read differently
        depth += (part == "[") - (part == "]")
        parts.append(part)
    try:
        quick = re.compile("".join(parts)).findall
    except re.error:
        return whole
    return lambda text: quick(text) if _PLAIN(text) else whole(text)


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    memory_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """Encode every whole text and decode its ids again.

    vocabulary: path of a rank file, read on the driver and broadcast (its size is
    checked). Returns the id column, n_tokens, ids_sha256 (decimal ids joined by a
    space), decoded_sha256 and n_bytes; with_ids adds ids array<int>. memory_entries
    bounds what a worker remembers; it changes the speed alone.
    """
    ranks = read_ranks(vocabulary)
    if sum(len(k) + 64 for k in ranks) > BROADCAST_LIMIT:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    with open(vocabulary, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    rows = input_columns(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(pattern)
        memory = _remembered(version, shared.value, memory_entries)
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                words = [find(text) for text in texts_of(batch)]
                look = memory.meet(set().union(*words)).__getitem__
                counts, digests, back, sizes, all_ids = [], [], [], [], []
                for found in words:
                    entries = list(map(look, found))
                    data = b"".join([entry[1] for entry in entries])
                    decimal = " ".join([entry[0] for entry in entries])
                    counts.append(sum([entry[2] for entry in entries]))
                    digests.append(hashlib.sha256(decimal.encode()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    sizes.append(len(data))
                    if with_ids:
                        all_ids.append(list(map(int, decimal.split())))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(back), pa.array(sizes, pa.int64())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                memory.tidy()

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids
    return map_rows(rows, schema, run).withColumnRenamed("id", id_col)


def decode_ids(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    """The bytes of a list of ids."""
    back = {rank: token for token, rank in ranks.items()}
    return b"".join(back[i] for i in ids)


class MergeCounter:
    """Token counts of pre-tokens under an ordered merge list with an end-of-word suffix."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], suffix: str):
        self.pairs = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = _byte_letters()
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        self.last = [vocab.get(letters[b] + suffix, -1) for b in range(256)]

    def count(self, data: bytes) -> int:
        """Initial symbols minus merges; symbols that the vocabulary lacks are dropped first."""
        symbols = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        n = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (hit := pairs(symbols[i] << 20 | symbols[i + 1])) is not None:
                heap.append((hit[0], i, symbols[i], symbols[i + 1], hit[1]))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        count = n
        while heap:
            _, i, a, b, whole = pop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (hit := pairs(whole << 20 | symbols[k])) is not None:
                    push(heap, (hit[0], i, whole, symbols[k], hit[1]))
            if (p := before[i]) >= 0 and (hit := pairs(symbols[p] << 20 | whole)) is not None:
                push(heap, (hit[0], p, symbols[p], whole, hit[1]))
        return count


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else 256 onwards."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


#: Letters that later Unicode versions than this Python's give a lower case.
_LOWER = str.maketrans({"Σ": "σ", "\ua7cb": "\u0264", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7dc": "\u019b"})


def _lower(text: str) -> str:
    """Lower case letter by letter (a capital sigma has no final form)."""
    return text.lower() if text.isascii() else text.translate(_LOWER).lower()


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text under a tokenizers file with merges and word ends.

    Returns the id column, n_bytes, n_tokens and over_limit (n_tokens > limit). The
    file's strings for special tokens count as one token each where a text has them.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    special = [t["content"] for t in spec["added_tokens"]]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    counter = MergeCounter(merges, model["vocab"], model["end_of_word_suffix"] or "")
    if len(counter.pairs) * 200 > BROADCAST_LIMIT:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(counter)
    rows = input_columns(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = shared.value
        find = finder(split)
        cut = re.compile("|".join(map(re.escape, special))).split

        class Known(dict):
            def __missing__(self, word: str) -> int:
                n = merger.count(word.encode())
                if len(word) <= CACHE_LENGTH:
                    if len(self) > CACHE_ENTRIES:
                        self.clear()
                    self[word] = n
                return n

        look = Known().__getitem__
        for whole in batches:
            for batch in chunks(whole, "text"):
                sizes, counts = [], []
                for text in texts_of(batch):
                    total = 0
                    parts = cut(text) if any(s in text for s in special) else [text]
                    for part in parts:
                        if not part.isascii():
                            part = compose(part)
                        total += sum(map(look, find(_lower(part))))
                    sizes.append(len(text.encode()))
                    counts.append(total + len(parts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(rows.dtypes)["id"]
    return map_rows(rows, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", run).withColumnRenamed("id", id_col)
