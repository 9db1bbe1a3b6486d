"""Genomics operators: formats, windows, interval joins, expressions, streaming and the oracles."""

import glob
import gzip
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from haplospark.functions import seq
from haplospark.operators import linear
from haplospark.operators.choose import matching, resolve
from haplospark.operators.interval import point_in_interval
from haplospark.operators.sampling import split_ids
from haplospark.operators.windows import greedy_windows
from haplospark.plans import registry
from haplospark.sources import catalog, formats
from haplospark.streaming.accumulate import event_windows, site_accumulators

SF = "/root/testdata/sf0.001"
VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr1\t10\trs1\tA\tC\t.\tPASS\t.\tGT:DP\t0/1:3\t1/1:2\t./.
1\t7\t.\tG\tT,A\t.\tPASS\t.\tGT\t1/0\t0|0\t1|1
2\t5\trs3\tG\t.\t.\tPASS\t.\tGT\t0/0\t0/0\t0/0
"""


def plain(rows):
    return sorted((tuple("" if x is None or x != x else f"{x:.5g}" if isinstance(x, float) else str(x) for x in r) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(columns).collect()
    if name in registry.oracle_sql():
        want = duck.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
        assert plain(rows) == plain(want)


def test_entry_and_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_vcf_scan(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    open(path, "w").write(VCF)
    got = {(r.chrom, r.pos, r.sample_id): r.gt for r in formats.read_calls(spark, path).collect()}
    assert got == {("1", 9, "s1"): "0/1", ("1", 9, "s2"): "1/1", ("1", 9, "s3"): None, ("1", 6, "s1"): "1/0", ("1", 6, "s2"): "0|0", ("1", 6, "s3"): "1|1"}
    assert formats.read_calls(spark, path, ["s2"], ["2"]).count() == 0
    with pytest.raises(KeyError):
        formats.read_calls(spark, path, ["s9"])
    variants = formats.read_variants(spark, path)
    assert sorted(map(tuple, variants.collect())) == [("1", 6, "1:7", "G", "T"), ("1", 9, "rs1", "A", "C")]
    calls = formats.read_calls(spark, path).join(variants.select("chrom", "pos", "variant_id"), ["chrom", "pos"])
    formats.write_vcf(calls, str(tmp_path / "out"), ["s1", "s2", "s3"])
    back = formats.read_calls(spark, str(tmp_path / "out"))
    assert {(r.chrom, r.pos, r.sample_id): r.gt for r in back.collect()} == got


def test_other_scans(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 x\nacgt\nNN\n>2\nTTT\n")
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("2", 3, "TTT"), ("chr1", 6, "ACGTNN")]
    (tmp_path / "a.gff").write_text("##gff\nChr1\tx\tgene\t11\t20\t.\t+\t.\tID=g1;Name=n\n1\tx\tmRNA\t11\t20\t.\t-\t.\tParent=g1\n")
    assert list(map(tuple, formats.read_gff(spark, str(tmp_path / "a.gff"), ["gene"]).collect())) == [("1", "gene", 10, 20, "+", "g1")]
    (tmp_path / "a.psam").write_text("#IID\tSEX\n007\t1\nb\t2\n")
    assert [r.iid for r in formats.read_samples(spark, str(tmp_path / "a.psam")).orderBy("sample_ord").collect()] == ["007", "b"]
    (tmp_path / "acc1.tsv").write_text("chrom\tpos\tstrand\tctx\tmc\ttotal\tx\nChr1\t5\t+\tCGA\t2\t4\t1\nchrM\t5\t+\tCGA\t2\t4\t1\n")
    assert list(map(tuple, formats.read_allc(spark, str(tmp_path / "acc1.tsv")).collect())) == [("acc1", "1", 5, "+", "CGA", 2, 4)]
    (tmp_path / "l.jsonl").write_text('{"step": 1, "loss": 0.5}\n{"step": 2, "lo')
    assert list(map(tuple, formats.read_ledger(spark, str(tmp_path / "l.jsonl"), "step int, loss double").collect())) == [(1, 0.5)]


def test_hapmap_and_soft_scans(spark, tmp_path):
    head = ["rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panel", "QCcode", "s1", "s2", "s3", "s4", "s5"]
    (tmp_path / "a.hmp.txt").write_text("\t".join(head) + "\n" + "\t".join(["m1", "A/G", "chr2", "11", "+"] + ["NA"] * 6 + ["A", "G", "R", "N", "Y"]) + "\n")
    got = formats.read_hapmap(spark, str(tmp_path / "a.hmp.txt"))
    assert {(r.chrom, r.pos, r.variant_id, r.sample_id): r.gt for r in got.collect()} == {
        ("2", 10, "m1", "s1"): "0/0", ("2", 10, "m1", "s2"): "1/1", ("2", 10, "m1", "s3"): "0/1", ("2", 10, "m1", "s4"): None, ("2", 10, "m1", "s5"): None
    }
    (tmp_path / "a.soft").write_text("^DATABASE = Geo\n!Database_name = x\n^SAMPLE = GSM1\n!Sample_title = a = b^c\n#ID = no\n^SAMPLE = GSM2\n!Sample_ch1 = ecotype: Col\n")
    assert sorted(map(tuple, formats.read_soft(spark, str(tmp_path / "a.soft")).collect())) == [
        ("DATABASE", "Geo", "Database_name", "x"), ("SAMPLE", "GSM1", "Sample_title", "a = b^c"), ("SAMPLE", "GSM2", "Sample_ch1", "ecotype: Col")
    ]


def test_genotype_modes_stay_apart(spark):
    df = spark.createDataFrame([(g,) for g in ("0/1", "1/0", "1/1", "1|1", "./.", "2/0", None, "0/0:9")], "gt string")
    got = df.select("gt", *[seq.genotype(F.col("gt"), m).alias(m) for m in ("first", "hom", "exact", "any")], seq.dosage(F.col("gt")).alias("d")).collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, 0, 0, 1, 1), (1, 0, 0, 1, 1), (1, 1, 1, 1, 2), (1, 1, 0, 1, 2), (0, 0, 0, 0, None), (0, 0, 0, 1, 1), (0, 0, 0, 0, None), (0, 0, 0, 0, 0)
    ]


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("ACGTN", [(1, "T"), (3, "A")])], "s string, alts array<struct<at:int,base:string>>")
    r = df.select(
        seq.reverse_complement(F.col("s")), seq.patch(F.col("s"), F.col("alts")), seq.kmers(F.col("s"), 2), seq.kmer_id(F.lit("CAT")),
        seq.kmer_id(F.lit("CAN")), seq.gc_fraction(F.col("s")), seq.chrom_number(F.lit("Chr12")), seq.chrom_number(F.lit("ChrM")),
    ).first()
    assert tuple(r) == ("NACGT", "ATGAN", ["AC", "CG", "GT", "TN"], 151672 + 2 * 16 + 0 * 4 + 1, 151671, 0.5, 12, None)


@pytest.mark.parametrize("closed", ["left", "both"])
def test_interval_join_is_brute_force(spark, closed):
    rng = random.Random(4)
    points = [(rng.randint(1, 3), rng.randint(-50, 300)) for _ in range(200)]
    spans = [(rng.randint(1, 3), s := rng.randint(-60, 300), s + rng.randint(0, 90)) for _ in range(40)]
    got = point_in_interval(spark.createDataFrame(points, "c int, p int"), spark.createDataFrame(spans, "c int, s int, e int"), ["c"], "p", "s", "e", closed, 32)
    want = [(c, p, s, e) for c, p in points for k, s, e in spans if c == k and s <= p and (p < e or (closed == "both" and p == e))]
    assert sorted(map(tuple, got.select("c", "p", "s", "e").collect())) == sorted(want)


def test_greedy_windows(spark):
    sites = spark.createDataFrame([(1, p) for p in (5, 8, 30, 31, 49, 200)], "chrom int, pos long")
    got = sorted(map(tuple, greedy_windows(sites, 10).collect()))
    assert got == [(1, -5, 15, 2), (1, 20, 40, 2), (1, 40, 60, 1), (1, 190, 210, 1)]
    assert sorted(map(tuple, greedy_windows(sites, 10, "overlap").collect())) == [(1, -5, 15, 2), (1, 20, 40, 2), (1, 39, 59, 1), (1, 190, 210, 1)]


def test_split_is_nested_and_deterministic(spark):
    ids = spark.range(101).withColumnRenamed("id", "iid")
    a = {r.iid: r.part for r in split_ids(ids, "iid", 1, {"val": 0.15, "test": 0.15}).collect()}
    assert a == {r.iid: r.part for r in split_ids(ids.repartition(7), "iid", 1, {"val": 0.15, "test": 0.15}).collect()}
    assert sorted((list(a.values()).count(p)) for p in ("val", "test")) == [15, 15]


def test_streams_equal_batches(spark, tmp_path):
    calls = spark.createDataFrame([(i % 7, i % 5, 5 + i % 3) for i in range(300)], "site int, mc int, total int")
    calls.repartition(3).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    q = site_accumulators(stream).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert plain(spark.table("acc").collect()) == plain(site_accumulators(calls).collect())
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = event_windows(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert plain(spark.table("ev").collect()) == plain(event_windows(events, "1 hour", "1 hour").collect())


def test_linear_models_match_direct_algebra(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) + 2
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60)
    rows = spark.createDataFrame([(i, [1.0, *map(float, x[i]), float(y[i])]) for i in range(60)] + [(60, None), (61, [1.0])], "i int, v array<double>")
    folds = linear.gram(rows.withColumn("fold", F.col("i") % 3), "v", "fold")
    want = []
    for f in range(3):
        held = np.arange(60) % 3 == f
        xt, yt = x[~held] - x[~held].mean(0), y[~held] - y[~held].mean()
        w = np.linalg.solve(xt.T @ xt + 7 * np.eye(3), xt.T @ yt)
        want.append(np.corrcoef(x[held] @ w, y[held])[0, 1])
    assert linear.ridge_grid(folds, [7.0])[0][1] == pytest.approx(np.mean(want))
    assert linear.ridge_grid({0: folds[0]}, [7.0]) == [(7.0, None)]
    g = linear.gram(rows.where("i < 60").select(F.slice("v", 1, 4).alias("v")), "v")[0]
    assert linear.principal_axes(g, 3)[2] == pytest.approx(np.linalg.svd(x - x.mean(0))[1])
    assert linear.principal_axes(g, 2, centre=False)[2] == pytest.approx(np.linalg.svd(x)[1][:2])
    assert linear.gram(rows.limit(0), "v") == {}


def test_axes_removed_matches_projection(spark):
    e = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)
    c = e - e.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:3]
    want = np.linalg.norm(c - c @ axes.T @ axes, axis=1)
    got = [r.after for r in registry.queries()["m12_axes_removed"](spark, SF).orderBy("vec_id").collect()]
    assert got == pytest.approx(want, abs=1e-5)


def test_choices_are_checked_when_planned(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (3, "c", 1.0)], "iid int, kind string, height double")
    assert [r.iid for r in matching(df, kind=["a", "c"], iid=3, height=None).collect()] == [3]
    assert resolve(df, None, ("iid", "kind")) == ["height"]
    with pytest.raises(ValueError, match="width"):
        resolve(df, ["width"])


def test_dart_scan(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    open(path, "w").write("*,*,*,*,*,11,x,12,11\n*,*,*,*,*,a,b,c,d\nAlleleID,CloneID,Seq,SNP,SnpPosition,p,q,r,s\nA1,C1,ACGT,2:G>T,2,0,1,-,2\nA2,C2,,3:A>C,3,1,1,1,1\n")
    got = [tuple(r) for r in formats.read_dart(spark, path, 5).orderBy("sample_id").collect()]
    assert got == [("A1", "C1", "ACGT", "2:G>T", 2, "11", "0"), ("A1", "C1", "ACGT", "2:G>T", 2, "12", None)]
    open(path, "w").close()
    assert formats.read_dart(spark, path, 5).count() == 0


def test_catalog_resolves_either_compression(spark, tmp_path):
    stem = str(tmp_path / "rice")
    with pytest.raises(FileNotFoundError, match="rice.vcf"):
        catalog.register(spark, {"rice": stem}, "rice")
    with gzip.open(f"{stem}.vcf.gz", "wt") as f:
        f.write(VCF)
    assert catalog.register(spark, {"rice": stem}, "dev", {"dev": "rice"}) == ["dev_variants", "dev_calls"]
    assert spark.sql("select count(*) as n from dev_calls").first().n == 6
    with pytest.raises(KeyError, match="soy"):
        catalog.register(spark, {"rice": stem}, "soy")
