"""Corpus operators against brute force, libraries and defined edge cases."""

import hashlib
import html as html_module
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from haplospark.llm import bpe, components, langid, license_scan, mixing, quality, simhash, spotsigs, suffix, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, size int, component string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "x", 1, 2, "y") for d, t, lang, s in rows], SCHEMA)


def edge_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éclair", "日本"]) for _ in range(9000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "the cat sat on the mat", "en", "b"),
        (4, "the cat sat on the mat", "en", "b"), (5, "the cat sat on the mat", "en", "b"), (None, "the null id of the row", "fr", None),
        (6, long, "en", "c"), (7, "x" * 20000, "de", "c"), (8, "MIT License, CC-BY 4.0; GNU General Public License v3", "en", "b"),
        (9, "\x00é 🎉 <|endoftext|> don't'S 12345½", None, "ü"), (10, "line one two\nline one two\nline one two\n" * 4, "en", ""),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 1 and 3: encoding and counts

def test_encoding_is_the_librarys(docs, edges):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, edges):
        got = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)
        want = []
        for r in df.collect():
            text = r.text or ""
            ids = library.encode_ordinary(text)
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())))
            assert bpe.decode_ids(ids, ranks) == text.encode()
        assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_rank_queue_matches_repeated_minimum():
    rng = random.Random(1)
    for _ in range(200):
        ranks = {bytes([b]): b for b in range(97, 101)}
        for _ in range(rng.randint(5, 60)):
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            if len(a + b) < 12:
                ranks.setdefault(a + b, rng.randint(0, 5000) * 2 + 300)
        ranks = {t: r for r, t in {r: t for t, r in ranks.items()}.items()}
        for b in range(97, 101):
            ranks.setdefault(bytes([b]), b)
        pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(5)]
        for piece, ids in zip(pieces, bpe.Encoder(ranks).encode(pieces)):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while piece not in ranks and len(parts) > 1:
                best = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if best[0] == 1 << 40:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_counts_are_the_librarys(docs, edges):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for df in (docs, edges):
        got = bpe.count_tokens(df, P.path("word_bpe_49k.json"), limit=100)
        want = []
        for r in df.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
        assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


# 2: SimHash

def brute_groups(rows, k=4, limit=4):
    prints = []
    for _, text in rows:
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    owner = list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                owner[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, f"{p:016x}", least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints))]


def test_simhash_groups(docs, edges):
    for df in (docs, edges):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert rows_of(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(brute_groups(rows), key=repr)


def test_grid_join_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    fps = [base]
    for _ in range(5):
        flips = np.zeros(300, np.uint64)
        for _ in range(4):
            flips |= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        fps.append(fps[rng.integers(0, len(fps))] ^ flips)
    fps = np.unique(np.concatenate([*fps, np.array([7 ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)], np.uint64)]))
    prints = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    labels = dict(components.connected_components(simhash.near_links(prints, 4)).collect())
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    seen, want = np.full(len(fps), -1), {}
    for i in range(len(fps)):
        if seen[i] >= 0:
            continue
        todo, seen[i] = [i], i
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (seen < 0)):
                seen[j] = i
                todo.append(int(j))
    signed = fps.view(np.int64)
    for i in set(seen.tolist()):
        members = signed[seen == i]
        if len(members) > 1:
            want |= {int(m): int(members.min()) for m in members}
    assert labels == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (9, 9)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000: 5000, 5001: 5000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4: quality

def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hot = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hot |= set(range(i, i + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hot)


def test_quality_measures(docs, edges):
    for df in (docs.where("length(text) < 4000"), edges.where("doc_id is null or doc_id <> 6")):
        got = quality.score_documents(df)
        want = []
        for r in df.collect():
            m = brute_measures(r.text)
            want.append((r.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
        assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
        assert not got.where("kept and base_failed").count()


def test_votes_recover_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    accuracy = np.array([0.9, 0.8, 0.7, 0.65, 0.85])
    right = rng.random((20000, 5)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 5)) < 0.8)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found = quality.fit_accuracies(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.05
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.9


def test_quality_keeps_the_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(docs).select("doc_id", "kept")
    got = scored.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    kept = dict(got.collect())
    assert kept[1] > 0.9 and kept[1] > kept[0]


# 5: language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.held_out())
    want = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect()}
    assert {r.doc_id: r.held for r in docs.collect()} == want
    sample = langid.fit_sample(docs.where("not held"))
    got = langid.identify(docs, sample, keep=["lang", "held"]).where("held").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def naive_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count += 1
        i += n
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    for _ in range(20):
        sample = "".join(rng.choice("abcd ") for _ in range(300))
        model = langid.Model({"x": sample})
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 250)))
        costs, letters = model.costs([text])
        stream = "".join(chr(s) for s in model.symbols(sample))
        phrases = costs[0, 0] * len(text) / model.automata[0].bits
        assert letters[0] and round(phrases) == naive_phrases("".join(chr(s) for s in model.symbols(text)), stream)


def test_long_texts_are_parsed_whole():
    rng = random.Random(5)
    sample = "".join(rng.choice("abcd ") for _ in range(1500)) + "e" * 600
    model = langid.Model({"x": sample})
    stream = "".join(chr(s) for s in model.symbols(sample))
    texts = ["".join(rng.choice("abcd") for _ in range(5000)), sample * 3, "e" * 4000, "ab" * 2000, sample[100:1300] + "e" * 3000 + "zz", "e" * 255 + "f", "", "q" * 700]
    costs, _ = model.costs(texts)
    for text, cost in zip(texts, costs[0]):
        symbols = model.symbols(text)
        assert round(cost * max(1, len(symbols)) / model.automata[0].bits) == naive_phrases("".join(map(chr, symbols)), stream)
    wide = langid.Model({"x": sample + "".join(chr(i) for i in range(0x4E00, 0x4E80))})  # too many letters for a table
    assert wide.automata[0].table() is None
    costs, _ = wide.costs(texts)
    stream = "".join(chr(s) for s in wide.symbols(sample + "".join(chr(i) for i in range(0x4E00, 0x4E80))))
    for text, cost in zip(texts, costs[0]):
        symbols = wide.symbols(text)
        assert round(cost * max(1, len(symbols)) / wide.automata[0].bits) == naive_phrases("".join(map(chr, symbols)), stream)


def test_language_edges(edges, empty):
    sample = {"en": "the cat sat on the mat and the dog", "fr": "le chat est sur le tapis et le chien"}
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(edges, sample).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= got
    assert langid.fit_sample(empty) == {}
    assert {r.lang_pred for r in langid.identify(edges, {}).collect()} == {"und"}


# 6: passages

def brute_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, sha((rows[i][1] or "").encode())[:32]))
    seen, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            piece = data[at : at + length]
            if piece in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((rows[i][0], len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


@pytest.mark.parametrize("length,passes", [(100, 4), (20, 2), (9, 1)])
def test_repeats_are_brute_force(spark, edges, length, passes):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(length - 2, 3 * length))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 9)))
        rows.append((rng.randint(0, 40), text, "en", "a"))
    rows += rows[:5] + edge_rows()
    df = frame(spark, rows).repartition(3)
    got = suffix.remove_repeats(df, length, keep=["lang", "id"], block_bytes=2000, bucket_entries=100, passes=passes)
    want = sorted(brute_repeats([r[:2] for r in rows], length), key=repr)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeats_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix.remove_repeats(docs)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute_repeats(rows, 100), key=repr)


def test_names_and_equality_of_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[3000:4000] = data[500:1500]
    every = np.arange(len(data) - 29)
    names = suffix.names_at(data, every, 30)
    few = rng.integers(0, len(every), 500)
    assert (suffix.names_at(data, few, 30) == names[few]).all()
    strings = [data[i : i + 30].tobytes() for i in every]
    at = np.concatenate([np.arange(3000, 3990), few, np.arange(10, 60)])
    to = np.concatenate([np.arange(500, 1490), few[::-1], np.arange(9, 59)])
    want = [strings[i] == strings[j] for i, j in zip(at, to)]
    assert suffix._equal(data, at, data, to, 30).tolist() == want and any(want) and not all(want)
    assert suffix._equal(data, at[:5], data.copy(), to[:5], 30).tolist() == want[:5]


def test_covers_are_covers():
    for v, cover in suffix.COVERS.items():
        for shift in range(v):
            assert any((a + shift) % v in cover for a in cover)


# 7: mixing

def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    out = mixing.targets({"a": 1000, "b": 10, None: 20})
    assert out["b"] == 30 and out[None] == 60 and abs(sum(out.values()) - 1030) < 1e-9


def test_mix_meets_its_targets(docs, edges):
    for df in (docs, edges):
        a = mixing.mix(df, block=16).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, mixing.mix(df.repartition(5), block=16).collect()))
        sizes = sorted((repr(r.doc_id), len(WORDS.findall(r.text or ""))) for r in df.collect())
        assert sorted((repr(r.doc_id), r["size"]) for r in a) == sizes
        by = {}
        for r in a:
            assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.passes * r["size"] + r.part and 0 <= r.part <= r["size"]
            by.setdefault(r.source, []).append(r)
        for rows in by.values():
            assert rows[0].source_size == sum(r["size"] for r in rows)
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1


# 8: SpotSigs

def test_compare_with_next(docs, edges):
    for df, part in ((docs, 16), (edges, 3), (edges, 4096)):
        rows = [(r.doc_id, r.text or "", r.text) for r in df.collect()]
        rows.sort(key=lambda r: ((r[0] is None, -(r[0] or 0)), r[2] is not None, r[2] or ""))
        want = []
        signer = spotsigs.Signer()
        for i, (doc, text, _) in enumerate(rows):
            follow = rows[(i + 1) % len(rows)][1]
            new = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
            a, b, c = (set(signer(t).tolist()) for t in (text, new, follow))
            want.append((doc, len(text), sha(new.encode()), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
        got = spotsigs.compare_with_next(df, rows_per_part=part).withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})
        assert rows_of(got, "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == sorted(want, key=repr)
        assert got.groupBy("fingerprint").count().count() <= len({r[1] for r in rows})


def test_near_pairs_are_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice([rng.choice(["the", "of", "a"]), f"w{rng.randrange(60)}"]) for _ in range(80)] for _ in range(8)]
    texts = []
    for i in range(40):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "q"
        texts.append((i, " ".join(words), "en", "a"))
    got = {(r.a, r.b) for r in spotsigs.near_pairs(frame(spark, texts), 0.8).collect()}
    signer = spotsigs.Signer()
    classes = {}
    for i, t, _, _ in texts:
        classes.setdefault(frozenset(signer(t).tolist()), i)
    heads = [(i, s) for s, i in classes.items()]
    want = {(min(i, j), max(i, j)) for i, s in heads for j, t in heads if i < j and len(s & t) / len(s | t) >= 0.8}
    assert got == want and want


# 9: WARC

def test_warc_records(spark):
    pages = [(1, "http://a/", "<html lang='en'><head><title>A &amp; B</title><script>x<y</script></head><body><p>One&nbsp;two<br>three</p><!-- no --><a href=x>four</a></body></html>"),
             (2, None, None), (3, "http://b/", ""), (1, "http://a/", "x")]
    sources = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 8 and {r.refers_to for r in got} == {r.record_id for r in sources}
    text = next(r for r in got if r.id == 1 and r.warc_type == "conversion" and r.source_length > 1)
    assert text.block == "One two\nthree\nfour" and text.content_length == len(text.block.encode())
    for r in got:
        assert r.block_digest == "sha1:" + hashlib.sha1(r.block.encode()).hexdigest()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"Content-Length: {r.content_length}\r\n" in r.header
        assert ("WARC-Target-URI" in r.header) == (r.target_uri is not None)
    meta = next(r for r in got if r.id == 1 and r.warc_type == "metadata" and r.source_length > 1)
    assert "title: A &amp; B\r\n" in meta.block and "language: en\r\n" in meta.block and "outlinks: 1\r\n" in meta.block


# 10: licenses

def test_license_base(docs, edges, spark):
    more = [(i, t, "en", "a") for i, t in enumerate(["mit license mit license", "MIT licenses", "cc by cc-by CC.BY", "été mit\x00license", "gnu general public license apache license"])]
    for df in (docs, edges, frame(spark, more)):
        want = []
        for r in df.collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
            places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            at = [i for i, _ in places]
            want.append((r.doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
        got = license_scan.scan(df)
        assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_suppression(spark):
    texts = [(1, "Apache License, Version 2.0", "", ""), (2, "GPL v2 or any later version", "", ""), (3, "licensed under CC BY-NC-SA 4.0 here", "", ""),
             (4, "Apache License. Apache License, Version 1.1", "", ""), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the MIT License)", "", "")]
    got = {r.doc_id: (r.labels, r.n_detections) for r in license_scan.scan(frame(spark, texts)).collect()}
    assert got[1] == ("apache,apache-2.0", 1)
    assert got[2] == ("gpl-2-or-later", 1)
    assert got[3] == ("cc-by,cc-by-nc-sa-4.0", 1)
    assert got[4] == ("apache,apache-1.1", 2)
    assert got[5][0] == "mit"
    assert len(license_scan.rules()) > 200


def test_license_scan_stays_in_the_jvm(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# all

def test_empty_tables(empty):
    assert bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert bpe.count_tokens(empty, P.path("word_bpe_49k.json")).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert quality.score_documents(empty).count() == 0
    assert langid.identify(empty, {}).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert spotsigs.compare_with_next(empty).count() == 0
    assert license_scan.scan(empty).count() == 0


def colliding_passages():
    """Two different passages of 100 bytes with one 64-bit name: the second word undoes what the first changed."""
    def step(x):
        x = x * int(suffix._MIX) % 2**64
        return x ^ x >> 29

    tail = "".join(random.Random(5).choices("abcdefghij ", k=84))
    for i in range(1, 100_000):
        heads = [f"{n:08d}".encode() for n in (0, i)]
        states = [step(100 ^ int.from_bytes(h, "little")) for h in heads]
        second = (int.from_bytes(b"passages", "little") ^ states[0] ^ states[1]).to_bytes(8, "little")
        if max(second) < 128:
            return heads[0].decode() + "passages" + tail, heads[1].decode() + second.decode() + tail
    raise AssertionError("no collision")


@pytest.mark.parametrize("passes", [1, 3])
def test_repeats_are_told_apart_by_their_bytes(spark, passes):
    a, b = colliding_passages()
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert a != b and len(set(suffix.names_at(data, np.array([0, 100]), 100).tolist())) == 1
    texts = [a + "x" * 8, b + "y" * 9, b + "z" * 10, a + b, a + "w" * 11]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, len(t.encode()), gone) for (i, t), gone in zip(rows, [0, 0, 100, 200, 100])]
    for block_bytes in (150, 1 << 20):
        got = suffix.remove_repeats(df, 100, block_bytes=block_bytes, bucket_entries=50, passes=passes)
        assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed").collect())) == want


def test_warc_records_keep_the_sources_headers(spark):
    from haplospark.llm import queries

    df = spark.createDataFrame([(1, "http://a/", "<p>é one</p>"), (2, None, None)], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 4
    for r in got:
        size = {1: 13, 2: 0}[r.id]
        lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
        assert r.http_head == "\r\n".join(lines) + "\r\n\r\n"
        for text, prefix in [(r.header, "WARC-Source-HTTP-")] + [(r.block, "http-")] * (r.warc_type == "metadata"):
            have = text.split("\r\n")
            assert {prefix + x for x in ["Status: " + lines[0], *lines[1:]]} <= set(have)
        assert r.content_length == len(r.block.encode()) and r.header.endswith("\r\n\r\n") and r.header.count("\r\n\r\n") == 1
        assert f"\r\nContent-Length: {r.content_length}\r\n" in r.header
    assert {"http_head", "header"} <= set(queries.op9_warc(spark, SF).columns)


def test_every_learned_letter_is_a_symbol(spark):
    rng = random.Random(11)
    scripts = {
        "de": "abcdefghijklmnopqrstuvwxyzäöüß", "ru": [chr(i) for i in range(0x430, 0x450)], "el": [chr(i) for i in range(0x3B1, 0x3CA)],
        "ar": [chr(i) for i in range(0x627, 0x63B)], "zh": [chr(i) for i in range(0x4E00, 0x4F00)],
        "ja": [chr(i) for i in range(0x3041, 0x3097)] + [chr(i) for i in range(0x5000, 0x5060)], "ko": [chr(i) for i in range(0xAC00, 0xAD00)],
        "goth": [chr(i) for i in range(0x10330, 0x10341)],
    }
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 6))) for _ in range(60)] for k, v in scripts.items()}
    # these share all letters of one script, and only their words tell them apart
    for k in ("ru", "zh"):
        words[k + "2"] = ["".join(rng.choice(scripts[k]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    sample = {k: text(k, 400) for k in words}
    model = langid.Model(sample)
    letters = {c for t in sample.values() for c in t if c.isalpha()}
    assert len({int(model.codes[ord(c)]) for c in letters} - {langid.BREAK, langid.OTHER, langid.PAD}) == len(letters) > 61
    assert any(a.table() is None for a in model.automata) and any(a.table() is not None for a in model.automata)
    for k, automaton in zip(model.languages, model.automata):
        stream = "".join(map(chr, model.symbols(sample[k])))
        for other in words:
            t = text(other, 12)
            have = model.symbols(t)
            costs, _ = model.costs([t])
            phrases = costs[model.languages.index(k), 0] * len(have) / automaton.bits
            assert round(phrases) == naive_phrases("".join(map(chr, have)), stream)
    rows = [(i, text(k, 30), k) for i, k in enumerate(list(words) * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, sample, keep=["lang"]).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)


def test_plain_text_keeps_all_visible_text(spark):
    cases = {
        "<nav><a href=/>home</a></nav><p>body</p>": "home\nbody",
        "<p>1 < 2 and 3 > 2</p><p>a <- b -> c</p>": "1 < 2 and 3 > 2\na <- b -> c",
        "&eacute;&#233;&#xE9; &#x1F389;&#8364;&euro; &mdash; &copy; &#39;&apos;&quot;": "ééé 🎉€€ — © ''\"",
        "&amp;lt; &lt;b&gt; AT&T &unknown; &# &#; & &&amp; x&nbsp;y&#160;z": "&lt; <b> AT&T &unknown; &# &#; & && x y z",
        "&#0;&#xD800;&#99999999;&#150;": "���–",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string").repartition(2)
    got = dict(map(tuple, df.select("html", warc.plain_text(F.col("html"))).collect()))
    assert got == cases


def plain_page(html):
    """What plain_text() gives, cut by hand."""
    def drop(text, names):
        out, at, low = [], 0, text.lower()
        while at < len(text):
            name = next((n for n in names if low.startswith("<" + n, at) and (n == "!--" or low[at + 1 + len(n) : at + 2 + len(n)] in set(" \t\n\r\f\v/>"))), None)
            if name is None:
                out.append(text[at])
                at += 1
                continue
            out.append(" ")
            inside = at + 1 + len(name)
            end = re.compile("-->" if name == "!--" else rf"</{name}\s*>").search(low, inside)
            body = re.compile(r"<body[\s/>]").search(low, inside) if name == "head" else None
            at = min(end.end() if end else len(text), body.start() if body else len(text))
        return "".join(out)

    text = drop(drop(html, ["!--", *warc.DROPPED.split("|")]), ["head"])
    out, at = [], 0
    while at < len(text):
        tag = re.compile(r"</?([A-Za-z!][^\s/>]*)").match(text, at)
        if not tag:
            out.append(text[at])
            at += 1
            continue
        end = text.find(">", tag.end(1) - 1 if tag[1].endswith(">") else tag.end(1))
        after = text[tag.end(1) : tag.end(1) + 1]
        if re.fullmatch(warc.BREAKING, tag[1], re.I) and after:
            out.append("\n")
        at = len(text) if end < 0 else end + 1
    words = re.sub(r"[ \t\r\f\x0b]+", " ", html_module.unescape("".join(out)).replace("\xa0", " "))
    return re.sub(r" *\n[ \n]*", "\n", words).strip(" \n")


def test_plain_text_is_brute_force(spark):
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<br/>", "<div class='x'>", "<!-- no -->", "<!--", "-->", "<script>", "</script>", "<SCRIPT src=x>", "<style a>", "</style >", "<head>", "</head>",
            "<body>", "<svg/>", "</svg>", "<header>", "<a href=x>", "</a>", "word", " ", "\n", "&amp;", "&lt;b&gt;", "1 < 2", "<", ">", "<li", "<title>t</title>", "<pre>", "\t", "<h2>", "<h7>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")
    got = dict(df.select("page_id", warc.plain_text(F.col("html")).alias("t")).collect())
    for i, page in enumerate(pages):
        assert got[i] == plain_page(page), page
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", warc.plain_text(F.col("html")).alias("t")).collect():
        assert r.t == plain_page(r.html)


def test_warc_edges(spark):
    kind = "page_id long, url string, html string, id string, text string, block int, record_id string, warc_date string"
    assert warc.derivatives(warc.responses(spark.createDataFrame([], kind))).count() == 0
    rows = [(1, "http://a/", "<p>x", "i", "t", 1, "r", None)] * 2 + [(None, None, None, None, None, None, None, "2020-01-02T03:04:05Z")]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, kind), date=F.col("warc_date"))).collect()
    assert len(got) == 6 and Counter(r.block for r in got if r.id == 1 and r.warc_type == "conversion") == {"x": 2}
    assert len({r.record_id for r in got if r.id == 1}) == 2
    assert {re.search("WARC-Date: (.*)\r\n", r.header)[1] for r in got} == {warc.EPOCH, "2020-01-02T03:04:05Z"}
    long = ["<p>\n" * 250_000, "<!-- " * 200_000, "<script " * 125_000, "<title>" * 140_000, "<a " * 300_000, "<html " * 150_000, "<head>" * 160_000, "&" * 300_000, " \n" * 400_000]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(long)], "page_id long, url string, html string")
    start = time.perf_counter()
    got = {(r.id, r.warc_type): r for r in warc.derivatives(warc.responses(df)).collect()}
    assert time.perf_counter() - start < 60 and len(got) == 18
    assert got[0, "conversion"].block == "" and got[7, "conversion"].block == long[7]


def test_license_scan_takes_long_texts(spark):
    phrase = "Licensed under the Apache License, Version 2.0 or the MIT License. "
    texts = [phrase * 15_000, "gpl v2 or later " * 20_000, "copyright 2020 " * 30_000, "gnu general " * 80_000]
    start = time.perf_counter()
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert time.perf_counter() - start < 90
    assert (got[0].n_base, got[0].labels, got[0].last_word) == (30_000, "apache,apache-2.0,mit", 12 * 15_000 - 2)
    assert got[1].n_detections == 20_000 and got[1].labels == "gpl-2-or-later"


def test_suppression_is_brute_force(spark):
    rng = random.Random(4)
    words = "apache license version 2 0 1 gpl gnu general public v2 or later any mit the cc by nc sa 4 bsd clause 3 in public domain copyright 2020 all rights reserved lesser".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    table = license_scan.rules()
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        norm = f" {text} "
        found = []
        for no, r in enumerate(table):
            if r.stem in norm:
                for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                    start = norm[: m.start()].count(" ") - 1
                    found.append((start, -(start + m[0].count(" ") + 1), r.priority, no))
        found.sort()
        keep = [d for k, d in enumerate(found) if not any(o[1] <= d[1] and o[2] <= d[2] for o in found[:k])]
        labels = {table[d[3]].label for d in keep} | {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in norm}
        assert got[i].labels == ",".join(sorted(labels)) and got[i].n_detections == len(keep)
        assert got[i].score == max([table[d[3]].weight for d in keep] + [0.6 if got[i].base_labels else 0.0])


def test_full_cells_lose_no_link():
    rng = np.random.default_rng(6)
    for spread in (6, 40):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        fps = np.unique(np.concatenate([base ^ sum((np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) * (rng.random(60) < 0.6) for _ in range(4)) for _ in range(spread)]))
        visit = rng.random(len(fps)) < 0.4
        a, b = simhash._cell_links(fps, visit, 4)
        assert len(fps) > (simhash.FULL_CELL if spread == 40 else 0)
        assert (np.bitwise_count(fps[a] ^ fps[b]) > 0).all()
        group = {i: i for i in range(len(fps))}

        def top(i):
            while group[i] != i:
                i = group[i]
            return i

        for x, y in zip(a.tolist(), b.tolist()):
            group[top(x)] = top(y)
        for i in range(len(fps)):
            for j in range(i):
                if not (visit[i] and visit[j]) and int(fps[i] ^ fps[j]).bit_count() <= 4:
                    assert top(i) == top(j)
