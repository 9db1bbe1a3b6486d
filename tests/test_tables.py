"""Sources for many samples, reference chunks, tables and split contracts."""

import random

import pytest
from pyspark.sql import functions as F

from haplospark.operators.splits import nested_dev, pending, resolve
from haplospark.sources import formats, reference, tables


def test_vcf_of_many_samples(spark, tmp_path):
    names = [f"s{i}" for i in range(5000)]
    gts = ["0/0", "0/1", "1/1", "./."]
    lines = ["##x", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)]
    lines += ["\t".join([f"Chr{k}", str(10 * k), ".", "A", "C", ".", "PASS", ".", "GT:DP"] + [gts[(i + k) % 4] + ":3" for i in range(5000)]) for k in (1, 2)]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    calls = formats.read_calls(spark, f"{tmp_path}/a.vcf")
    got = {(r.chrom, r.sample_ord): (r.sample_id, r.gt) for r in calls.collect()}
    assert len(got) == 10000 and all(got[str(k), i] == (f"s{i}", None if gts[(i + k) % 4] == "./." else gts[(i + k) % 4]) for k in (1, 2) for i in range(5000))
    few = formats.read_calls(spark, f"{tmp_path}/a.vcf", ["s7", "s4999"], ["2"]).collect()
    assert sorted((r.sample_id, r.sample_ord, r.gt) for r in few) == [("s4999", 4999, "0/1"), ("s7", 7, "0/1")]
    known = calls.where("gt is not null and sample_ord <> 5").withColumn("variant_id", F.lit("v"))
    shift = spark.createDataFrame([("1", 9, 99)], "chrom string, pos long, new_pos long")
    formats.write_vcf(formats.remap_calls(known, shift, drop_unmapped=False), f"{tmp_path}/b", names)
    back = spark.read.text(f"{tmp_path}/b").where("value not like '#%'").collect()
    rows = sorted(r.value.split("\t") for r in back)
    assert [r[:2] for r in rows] == [["1", "100"], ["2", "20"]] and all(len(r) == 5009 for r in rows)
    for k, row in zip((1, 2), rows):
        assert row[9:] == ["./." if i == 5 else gts[(i + k) % 4] for i in range(5000)]


def test_hapmap_keeps_proper_alleles(spark, tmp_path):
    head = "\t".join(["rs#", "alleles", "chrom", "pos", *"strand a b c d e f".split(), "x", "y"])
    body = ["\t".join([n, a, "1", "5", *"+......", g, h]) for n, a, g, h in (("r1", "A/C", "A", "M"), ("r2", "A/A", "A", "A"), ("r3", "A/-", "A", "A"))]
    (tmp_path / "h.txt").write_text("\n".join([head, *body]) + "\n")
    got = formats.read_hapmap(spark, f"{tmp_path}/h.txt").collect()
    assert sorted((r.variant_id, r.sample_id, r.sample_ord, r.gt) for r in got) == [("r1", "x", 0, "0/0"), ("r1", "y", 1, "0/1")]


def test_reference_chunks_and_windows(spark, tmp_path):
    rng = random.Random(1)
    genome = {"1": "".join(rng.choice("ACGT") for _ in range(5000)), "scaffold_9": "ACGT" * 50, "2": "".join(rng.choice("acgtn") for _ in range(1234))}
    lines = []
    for name, seq in genome.items():
        lines += [f">Chr{name} a > b" if name.isdigit() else f">{name}", *[seq[i : i + 60] for i in range(0, len(seq), 60)]]
    (tmp_path / "g.fa").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            chunks = reference.read_chunks(spark, f"{tmp_path}/g.fa", 700)
            got = {}
            for r in chunks.orderBy("chrom", "chunk_no").collect():
                assert r.chunk_no == len(got.get(r.chrom, "")) // 700
                got[r.chrom] = got.get(r.chrom, "") + r.seq
            assert got == {1: genome["1"], 2: genome["2"].upper()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cases = [(i, 1 + i % 2, rng.randint(-40, 5100), rng.randint(1, 1500)) for i in range(60)] + [(60, 7, 3, 5)]
    windows = spark.createDataFrame(cases, "id int, chrom int, start long, width long")
    alts = F.array(F.struct(F.lit(0).alias("at"), F.lit("X").alias("base")))
    plain = {r.id: r.seq for r in reference.fetch_windows(chunks, windows, chunk=700).collect()}
    laid = {r.id: r.seq for r in reference.fetch_windows(chunks, windows, alts, 700).collect()}
    for i, chrom, start, width in cases:
        seq = got.get(chrom, "")
        assert plain[i] == "".join(seq[k] if 0 <= k < len(seq) else "N" for k in range(start, start + width))
        assert laid[i] == "X" + plain[i][1:]
    (tmp_path / "g.fai").write_text("Chr1\t5000\t1\t60\t61\nscaffold_9\t200\t1\t60\t61\nChr2\t1234\t1\t60\t61\n")
    assert sorted(map(tuple, reference.read_layout(spark, f"{tmp_path}/g.fai").collect())) == [(1, 5000, 0), (2, 1234, 5000)]


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,h,w\n007,1.5,x\n8,,2\n")
    assert sorted(map(tuple, tables.read_phenotypes(spark, f"{tmp_path}/p.csv", "id").collect()), key=repr) == sorted([("007", "h", 1.5), ("007", "w", None), ("8", "h", None), ("8", "w", 2.0)], key=repr)
    for n in (3, 12):
        (tmp_path / f"trait_{n}.tsv").write_text(f"a\tb\n1\t{n}\n")
    got = tables.read_by_file(spark, f"{tmp_path}/trait_*.tsv", r"trait_(\d+)\.tsv", "\t").collect()
    assert sorted((r.file_id, r.b) for r in got) == [("12", "12"), ("3", "3")]
    (tmp_path / "m.txt").write_text("gene  x.A1  x.B2\ng1  1  2\ng2 nan 4\n")
    got = {(r.row_id, r["sample"]): r.value for r in tables.read_matrix(spark, f"{tmp_path}/m.txt", r"x\.(\w+)").collect()}
    assert got["g1", "A1"] == 1 and got["g1", "B2"] == 2 and got["g2", "B2"] == 4 and len(got) == 4
    (tmp_path / "bare.tsv").write_text("1\t2\t3\n4\t5\t6\n")
    want = {("r1", "a"): 1, ("r1", "b"): 2, ("r1", "c"): 3, ("r2", "a"): 4, ("r2", "b"): 5, ("r2", "c"): 6}
    for rows, columns in ((["r1", "r2"], ["a", "b", "c"]), (["a", "b", "c"], ["r1", "r2"])):
        got = tables.read_bare_matrix(spark, f"{tmp_path}/bare.tsv", rows, columns).collect()
        assert {(r.row_id, r.column_id) if rows[0] == "r1" else (r.column_id, r.row_id): r.value for r in got} == want
    with pytest.raises(ValueError):
        tables.read_bare_matrix(spark, f"{tmp_path}/bare.tsv", ["r1"], ["a"])
    (tmp_path / "te.txt").write_text("name\to\tmin\tmax\nAT3TE00010\tx\t5\t9\n")
    assert [tuple(r) for r in tables.read_elements(spark, f"{tmp_path}/te.txt").collect()] == [("AT3TE00010", 3, 5, 9)]
    (tmp_path / "two.csv").write_text("text,label\nACGT,1\n")
    (tmp_path / "three.csv").write_text("a,b,label\nAC,GT,0\n")
    assert [tuple(r) for r in tables.read_labelled(spark, f"{tmp_path}/two.csv").collect()] == [("ACGT", None, 1)]
    assert [tuple(r) for r in tables.read_labelled(spark, f"{tmp_path}/three.csv").collect()] == [("AC", "GT", 0)]
    for step in (1, 2):
        tables.append_metrics(spark.createDataFrame([(step, 0.5 * step)], "step int, loss double"), f"{tmp_path}/log")
        tables.append_run(spark, {"run_id": step, "model": {"name": "ridge", "alpha": None}}, f"{tmp_path}/manifest")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    got = {r.run_id: r["values"] for r in tables.read_manifest(spark, f"{tmp_path}/manifest").collect()}
    assert got["2"] == {"run_id": "2", "model.name": "ridge", "model.alpha": ""} and set(got) == {"1", "2"}


def test_split_contracts(spark):
    split = spark.createDataFrame([(i, "val" if i % 10 == 0 else "train") for i in range(100)], "id long, part string")
    dev = nested_dev(split, "id").where("dev").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in dev} == {"val": 1, "train": 9}
    current = spark.createDataFrame([(i, f"s{i}") for i in range(1, 100)], "id long, name string")
    with pytest.raises(KeyError):
        resolve(split, current, "id")
    assert resolve(split, current, "id", require_all=False).count() == 99
    work = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "k int, name string")
    ledger = spark.createDataFrame([(2, "a"), (2, "a"), (None, "b")], "k int, name string")
    assert [tuple(r) for r in pending(work, ledger, ["k", "name"]).collect()] == [(1, "a")]


def test_phenotypes_of_thousands_of_traits(spark, tmp_path):
    names = [f"t{k}" for k in range(5000)]
    lines = ["id," + ",".join(names)] + [f"s{i}," + ",".join("NA" if (i + k) % 7 == 0 else str(i * k) for k in range(5000)) for i in range(3)]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    found = tables.read_phenotypes(spark, f"{tmp_path}/wide.csv", "id").collect()
    assert {(r.iid, r.trait): r.value for r in found} == {(f"s{i}", f"t{k}"): None if (i + k) % 7 == 0 else float(i * k) for i in range(3) for k in range(5000)}
    assert len(found) == 15000
    assert tables.read_phenotypes(spark, f"{tmp_path}/wide.csv", "id", traits=["t9", "t3"]).select("trait").distinct().count() == 2
    assert tables.read_phenotypes(spark, f"{tmp_path}/wide.csv", "id", traits=[]).count() == 0
