"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

from tests.llm.test_operators import WORDS, brute_groups, brute_repeats, edge_rows, frame, sha

import corpus_pipeline as pipeline


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_in_turn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "passage_dedup", "source_mix", "encode"]
    kept = pipeline.language_id(spark, docs, "")
    assert texts(kept) == Counter((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    unique = pipeline.near_dedup(spark, kept, "").cache()
    groups = brute_groups([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in unique.collect()} == {d for d, _, c in groups if d == c}
    cut = pipeline.passage_dedup(spark, unique, "").cache()
    want = {d: (n - gone) for d, n, gone, _, _ in brute_repeats([(r.doc_id, r.text) for r in unique.collect()], 100)}
    for r in cut.collect():
        assert 0 <= want[r.doc_id] - len(r.text.encode()) <= 200 and r.n_chars == len(r.text)
    mixed = pipeline.source_mix(spark, cut, "").cache()
    whole = {r.doc_id: r.text for r in cut.collect()}
    for r in mixed.collect():
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    total = sum(len(WORDS.findall(t)) for t in whole.values())
    assert abs(sum(len(WORDS.findall(r.text)) for r in mixed.collect()) - total) <= 30
    encoded = pipeline.encode(spark, mixed, "").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in encoded) == Counter((r.doc_id, sha(r.text.encode())) for r in mixed.collect())
    for df in (kept, unique, cut, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes


def test_stages_take_edges_and_empty_tables(spark):
    for rows in (edge_rows(), []):
        docs = frame(spark, rows)
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            docs.count()
        assert pipeline.encode(spark, docs, "").count() >= (4 if rows else 0)


def test_one_row_of_each_near_group_stays(spark):
    from haplospark.llm import simhash

    rows = [r for r in edge_rows() if r[1] and r[1].strip()]
    rows += [(None, "the cat sat on the mat", "en", "b"), (None, "the null id of the row", "fr", None), (None, "only nulls hold this text", "fr", "b")] * 2
    rows += [(3, "the cat sat on the mat", "en", "z"), (4, "another text that shares the id of the cats", "en", "b"), (8, "and one with the id of the licenses", "en", "b")]
    prints = [simhash.fingerprint(r[1], 4) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    got = pipeline.near_dedup(spark, frame(spark, rows).repartition(3), "").collect()
    have = Counter((r.doc_id, r.text, r.lang, r.source) for r in got)
    want = Counter()
    for g in set(group):
        members = [r for r, x in zip(rows, group) if x == g]
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
        here = [r for r in set(members) if r in have]
        assert len(here) == 1 and here[0][0] == least
        want[here[0]] += 1
    assert have == want
    assert len(pipeline.near_dedup(spark, frame(spark, []), "").collect()) == 0


def test_run_leaves_only_its_last_input(spark, tmp_path):
    from haplospark.llm import common

    frame(spark, edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    before = common.written()
    kept = common.materialise(spark.range(3))
    found = pipeline.run(spark, str(tmp_path))
    assert len(common.written() - before) == 2 and kept.count() == 3
    assert found.count() >= 4
