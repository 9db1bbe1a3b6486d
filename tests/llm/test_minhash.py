"""MinHash groups against all pairs, the sketch against its definition, and the defined edge cases."""

import random

import duckdb
import numpy as np
import pytest

from haplospark.llm import components, minhash
from haplospark.llm.oracles import ORACLES
from haplospark.llm.queries import queries
from tests.llm.test_operators import SF, WORDS, edge_rows, frame


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(text or "")]


def brute_groups(docs, k=3, percent=85):
    sets = []
    for _, text in docs:
        w = words_of(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def variants(rng, n, words, edits, start):
    """n copies of one text, each with up to edits of its words replaced."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append((start + k, " ".join(text), "en", "a"))
    return out


@pytest.mark.parametrize("chunk", [1, 100])
def test_groups_equal_all_pairs_whole_and_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_SETS", minhash.CHUNK_SETS // 256 if chunk > 1 else minhash.CHUNK_SETS)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", minhash.CHUNK_SHINGLES // (chunk * 10) if chunk > 1 else minhash.CHUNK_SHINGLES)
    rng = random.Random(chunk)
    cases = edge_rows() + variants(rng, 60, 90, 4, 100) + variants(rng, 30, 30, 1, 200) + variants(rng, 20, 9, 1, 300) + variants(rng, 10, 3, 1, 400)
    passage = " ".join(f"p{i}" for i in range(60))
    cases += [(500 + k, passage + " " + " ".join(f"u{k}x{i}" for i in range(40)), "en", "b") for k in range(40)]  # one passage, no links
    cases += [(600 + k, " ".join(f"c{i}" for i in range(40 + k)), "en", "b") for k in range(40)]  # a chain of growing texts
    cases += [(700, "One Two", "en", "a"), (701, "one two", "en", "a"), (702, "one", "en", "a"), (703, "two one", "en", "a"), (None, "one two", "en", "a"), (704, None, "en", "a")]
    docs = [(d, t) for d, t, _, _ in cases]
    got = minhash.near_duplicates(frame(spark, cases).repartition(5))
    assert rows(got) == brute_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_empty_table_and_thresholds(spark):
    assert rows(minhash.near_duplicates(frame(spark, []))) == []
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, []), percent=50)
    # 17 of 20 shingles: exactly 0.85
    a = " ".join(f"w{i}" for i in range(22))
    b = " ".join(f"w{i}" for i in range(19))
    c = " ".join(f"w{i}" for i in range(18))
    cases = [(1, a, "en", "a"), (2, b, "en", "a")]
    assert [r.component_id for r in minhash.near_duplicates(frame(spark, cases)).collect()] == [1, 1]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, [(1, a, "en", "a"), (2, c, "en", "a")])).collect()} == {1, 2}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 50, 400, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        out = minhash.sketch(s)
        assert (out != np.iinfo(np.uint64).max).all()
        one_by_one = np.minimum.reduce([minhash.sketch(s[i : i + 1]) for i in range(len(s))]) if n <= 50 else out
        assert (out == one_by_one).all()  # a union's sketch is the least of the sketches
    for n, shared in ((8, 7), (100, 85), (1000, 500)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])
        want = shared / (2 * n - shared)
        got = np.mean([(minhash.sketch(a + np.uint64(k)) == minhash.sketch(b + np.uint64(k))).mean() for k in range(30)])
        assert abs(got - want) < 0.05


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries()["op13_minhash"](spark, SF)
    found = con.execute(ORACLES["op13_minhash"])
    assert [c[0] for c in found.description] == got.columns
    assert rows(got) == sorted(found.fetchall(), key=repr)


def test_bitmap_keeps_every_wanted_row_and_few_others(spark, monkeypatch):
    texts = spark.range(4000).selectExpr("unhex(md5(cast(id as string))) as row", "id")
    for bits in (1 << 27, 1 << 13, 8):
        monkeypatch.setattr(minhash, "FILTER_BITS", bits)
        kept = {r.id for r in minhash._wanted(texts, texts.where("id % 10 = 3").select("row")).collect()}
        assert {i for i in range(4000) if i % 10 == 3} <= kept
        assert len(kept) < 700 if bits > 8 else len(kept) == 4000
    assert minhash._wanted(texts, texts.where("false").select("row")).count() == 0


def test_no_join_is_a_broadcast(spark, monkeypatch):
    """A broadcast is bounded by a packed file's size, not by what it takes in the driver's memory."""
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for module in (minhash, components):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, real=real: (plans.append(plan(df)), real(df))[1])
    rng = random.Random(4)
    docs = [r for k in range(5) for r in variants(rng, 6, 40, 1, 10 * k)]
    out = minhash.near_duplicates(frame(spark, docs))
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in [*plans, plan(out)] if "bitmap_construct_agg" not in p)
    assert len({r.component_id for r in out.collect()}) < len(docs)
