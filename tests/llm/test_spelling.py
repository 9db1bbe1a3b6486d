"""Spelling variants against all pairs, and the defined edge cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from haplospark.llm import spelling
from haplospark.llm.oracles import ORACLES
from haplospark.llm.queries import queries
from tests.llm.test_operators import SF, edge_rows, frame


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_apart(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = []
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows, key=repr)


def brute_counts(docs, one_in=97, min_length=5, min_count=3):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_length:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("letters", [1 << 18, 40, 4])
def test_groups_equal_all_pairs_however_small_the_partitions(spark, letters):
    rng = random.Random(letters)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(260)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "ÀàÉéÿ", "Ààéé", "ÀàÉéÿÿ", "àÉéÿ", "x" * 900, "x" * 901, "x" * 450 + "y" + "x" * 450, "a", "b", "ab", "ba"}
    counts = {w: rng.choice([1, 2, 3, 5, 5, 9, 20, 47]) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(spelling.group_variants(table, letters=letters)) == brute_groups(counts)


def test_trie_of_strings():
    rng = random.Random(2)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    found = dict(spelling.Trie(strings).near())
    assert {i: sorted(x) for i, x in found.items()} == {i: [j for j, b in enumerate(strings) if one_apart(a, b)] for i, a in enumerate(strings)}


def test_vocabulary_and_edges(spark):
    cases = edge_rows() + [(20 + k, "Garden gardEN ÉCLAIR éclair×÷ gardn garde " * 3 + "z" * 5000, "en", "a") for k in range(40)]
    cases += [(None, "garten gartens garten", "de", "a"), (None, "garten Gartens gartens", "de", "a"), (20, "Garden gardEN", "en", "a")]
    docs = [(d, t) for d, t, _, _ in cases]
    for one_in, min_length, min_count in ((97, 5, 3), (3, 4, 1), (1, 1, 2)):
        want = brute_counts(docs, one_in, min_length, min_count)
        vocabulary = spelling.vocabulary(frame(spark, cases).repartition(3), one_in=one_in, min_length=min_length, min_count=min_count)
        assert {r.word: r.n for r in vocabulary.collect()} == want
        got = spelling.spelling_variants(frame(spark, cases).repartition(3), one_in=one_in, min_length=min_length, min_count=min_count)
        assert rows(got) == brute_groups(want)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(spelling.spelling_variants(frame(spark, []))) == []
    with pytest.raises(ValueError):
        spelling.group_variants(vocabulary, ratio=1)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries()["op12_spelling_variants"](spark, SF)
    found = con.execute(ORACLES["op12_spelling_variants"])
    assert [c[0] for c in found.description] == got.columns
    assert rows(got) == sorted(found.fetchall(), key=repr)
