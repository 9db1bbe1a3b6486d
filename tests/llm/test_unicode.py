"""Both tokenizers against their libraries on code points whose class differs between Unicode versions."""

import json

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from haplospark.llm import bpe


def code_points(ranges):
    for part in ranges.split():
        low, high = (int(x, 16) for x in (part.split("-") * 2)[:2])
        yield from (c for c in range(low, high + 1) if c < 0x30000 or c in (low, high) or c % 97 == 0)


LISTED = [*code_points(bpe._NOT_YET), *code_points(bpe._NO_MARKS)]
#: A share of all others; sweeps over every code point gave no others.
OTHERS = [c for c in (*range(0x3000), *range(0x3000, 0x110000, 61)) if not 0xD800 <= c <= 0xDFFF]


@pytest.mark.parametrize("form", ["{}'s", "a{}́", "ạ{}́b", " {}", "A{}B's", "1{}2"])
def test_code_points_in_context(form):
    texts = [form.format(chr(c)) for c in LISTED + OTHERS]
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoder, find = bpe.Encoder(ranks), bpe.finder(P.PATTERN)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [find(t) for t in texts]
    flat = [w.encode() for found in words for w in found]
    ids = iter(encoder.encode(flat))
    got = [[i for _ in found for i in next(ids)] for found in words]
    assert [t for t, a, b in zip(texts, got, library.encode_ordinary_batch(texts)) if a != b] == []

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    counter = bpe.MergeCounter(merges, model["vocab"], model["end_of_word_suffix"] or "")
    find = bpe.finder(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    counts = [sum(counter.count(w.encode()) for w in find(bpe._lower(bpe.compose(t)))) for t in texts]
    found = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, counts, found) if a != len(b.ids)] == []
