"""Fill-in-the-middle against a plain version and the defined edge cases."""

import hashlib

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from haplospark.llm import fim
from haplospark.llm.oracles import ORACLES
from haplospark.llm.queries import queries
from tests.llm.test_operators import SF, edge_rows, frame, sha


def plain(doc_id, text):
    """The contract, step by step."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text.encode()), sha(text.encode())
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        form, out = "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    else:
        form, out = "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    return doc_id, n, form, a, b - a, sha(out.encode()), sha(text.encode())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edges_and_long_texts(spark):
    cases = edge_rows() + [
        (11, "a<P>b", "en", "a"), (12, "x<S>", "en", "a"), (13, "<M>", "en", "a"), (14, "<P<S<M", "en", "a"), (15, "<", "en", "a"), (16, "S><P", "en", "a"),
        (17, "é🎉́" * 200_000, "en", "a"), (-18, "negative id", "en", "a"), (None, None, None, None),
    ] + [(k, "ab<P" * 3 + "\r\n" * (k % 3), "en", "a") for k in range(20, 90)]
    got = fim.fill_in_middle(frame(spark, cases).repartition(3))
    assert rows(got) == sorted((plain(d, t) for d, t, _, _ in cases), key=repr)
    assert {r[2] for r in rows(got)} == {"plain", "psm", "spm"}
    assert got.columns[0] == "doc_id" and rows(fim.fill_in_middle(frame(spark, []))) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries()["op11_fill_in_middle"](spark, SF)
    found = con.execute(ORACLES["op11_fill_in_middle"])
    assert [c[0] for c in found.description] == got.columns
    assert rows(got) == sorted(found.fetchall(), key=repr)


def test_units_of_a_pattern_and_the_output_column(spark):
    texts = [(k, "one two  three\nfour" * (k % 5) + "!", "en", "a") for k in range(60)]
    out = fim.fill_in_middle(frame(spark, texts), unit=r"\S+", percent=100, spm_percent=50, version=2, sentinels=("<|p|>", "<|s|>", "<|m|>"), with_output=True)
    for r in out.collect():
        text = texts[r.doc_id][1]
        ends = [0, *(m.end() for m in regex.finditer(r"\S+", text))]
        assert r.n == len(ends) - 1 and r.form != "plain" and r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
        assert fim.restore(r.output, r.form, ("<|p|>", "<|s|>", "<|m|>")) == text and r.restored_sha256 == sha(text.encode())
        assert r.output_sha256 == sha(r.output.encode())
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, texts), sentinels=("<P>", "<P>x", "<M>"))


def test_no_shuffle(spark):
    plan = fim.fill_in_middle(frame(spark, edge_rows()).select("doc_id", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
