"""Variant filters, keyed and reference joins, carrier statistics and novelty."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.interval import point_in_interval
from haplospark.plans.base import ALLC, DOSAGE, PHENO, SITES, allc, dosage, pheno, sites
from haplospark.plans.registry import query, table

#: (id, chrom, pos, ref, alt) from part.
VAR = """var as (select p_partkey as id, cast(1 + p_partkey % 7 as integer) as chrom, p_partkey * 3 as pos,
  substr('ACGT', cast(p_size % 4 as integer) + 1, 1) as ref, substr('ACGTN-', cast(p_partkey % 6 as integer) + 1, 1) as alt from part)"""
#: (gene, line, y, p): truth and prediction of each line item.
PAIRS = "pairs as (select l_partkey as gene, l_suppkey as line, l_orderkey, l_linenumber, l_extendedprice / 1000 as y, l_quantity * 1.5 as p from lineitem)"


def one():
    return F.count(F.lit(1))


def r6(c):
    return F.round(c, 6)


def variants(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey as id", "cast(1 + p_partkey % 7 as integer) as chrom", "p_partkey * 3 as pos",
        "substr('ACGT', cast(p_size % 4 as integer) + 1, 1) as ref", "substr('ACGTN-', cast(p_partkey % 6 as integer) + 1, 1) as alt",
    )


def pairs(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_partkey as gene", "l_suppkey as line", "l_orderkey", "l_linenumber", "l_extendedprice / 1000 as y", "l_quantity * 1.5 as p"
    )


@query("p1_snv_filter", f"with {VAR} select id, chrom, pos, ref, alt from var where alt in ('A', 'C', 'G', 'T') and ref in ('A', 'C', 'G', 'T') and alt <> ref")
def p1(spark, d):
    known = list("ACGT")
    return variants(spark, d).where(F.col("alt").isin(known) & F.col("ref").isin(known) & (F.col("alt") != F.col("ref")))


@query("a29_site_accounting", f"with {VAR} select chrom, count(*) as n, count(case when alt = '-' then 1 end) as no_alt, count(case when alt = 'N' then 1 end) as unknown, count(case when alt = ref then 1 end) as same from var group by 1")
def a29(spark, d):
    tally = {"no_alt": F.col("alt") == "-", "unknown": F.col("alt") == "N", "same": F.col("alt") == F.col("ref")}
    return variants(spark, d).groupBy("chrom").agg(one().alias("n"), *[F.count_if(c).alias(k) for k, c in tally.items()])


@query("p4_min_coverage", f"with {ALLC} select accession, chrom, site, round(mc * 1.0 / greatest(total, 1), 6) as level from allc where total >= 5")
def p4(spark, d):
    return allc(spark, d).where("total >= 5").select("accession", "chrom", "site", r6(F.col("mc") / F.greatest("total", F.lit(1))).alias("level"))


@query("p10_polymorphic_in_train", f"with {DOSAGE} select variant, round(avg(dosage) / 2, 6) as p from dosage where sample % 4 <> 0 group by 1 having avg(dosage) / 2 > 0 and avg(dosage) / 2 < 1")
def p10(spark, d):
    train = dosage(spark, d).where("sample % 4 <> 0")
    return train.groupBy("variant").agg((F.avg("dosage") / 2).alias("p")).where("p > 0 and p < 1").select("variant", r6("p").alias("p"))


@query("p11_scoreable_genes", f"with {PAIRS} select gene, count(*) as n, round(stddev_samp(y), 6) as sd from pairs group by 1 having stddev_samp(y) > 0.001")
def p11(spark, d):
    return pairs(spark, d).groupBy("gene").agg(one().alias("n"), F.stddev_samp("y").alias("sd")).where("sd > 0.001").withColumn("sd", r6("sd"))


@query("p16_matched_complete", f"with {PHENO} select grp, count(value) > 0 as matched, count(value) = count(*) as complete from pheno group by 1")
def p16(spark, d):
    return pheno(spark, d).groupBy("grp").agg((F.count("value") > 0).alias("matched"), (F.count("value") == one()).alias("complete"))


@query("j2_key_extraction", "select o_orderkey, c_acctbal as value from orders join customer on cast(split_part(concat('NSF_', o_custkey), '_', 2) as bigint) = c_custkey")
def j2(spark, d):
    key = F.element_at(F.split(F.concat(F.lit("NSF_"), F.col("o_custkey")), "_"), -1).cast("long")
    o = table(spark, d, "orders").select("o_orderkey", key.alias("c_custkey"))
    return o.join(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value")), "c_custkey").select("o_orderkey", "value")


@query("j5_cis_inclusive", f"with {SITES}, {VAR} select v.id, s.pos - v.pos as distance from var v join sites s on s.chrom = v.chrom and s.pos between v.pos - 20 and v.pos + 20")
def j5(spark, d):
    v = variants(spark, d).select("id", F.col("chrom"), (F.col("pos") - 20).alias("lo"), (F.col("pos") + 20).alias("hi"))
    near = point_in_interval(sites(spark, d), v, ["chrom"], "pos", "lo", "hi", "both", 64)
    return near.select("id", (F.col("pos") - F.col("lo") - 20).alias("distance"))


@query("j7_single_match", f"with {SITES}, {VAR} select v.id, min(s.pos) as pos from var v join sites s on s.chrom = v.chrom and s.pos >= v.pos and s.pos < v.pos + 15 group by 1 having count(*) = 1")
def j7(spark, d):
    v = variants(spark, d).select("id", "chrom", F.col("pos").alias("lo"), (F.col("pos") + 15).alias("hi"))
    near = point_in_interval(sites(spark, d), v, ["chrom"], "pos", "lo", "hi", "left", 64)
    return near.groupBy("id").agg(F.min("pos").alias("pos"), one().alias("n")).where("n = 1").drop("n")


OVERLAY = """spans as (select chrom, pos as lo, pos + 30 as hi, 3 as priority from var where alt = '-'
  union all select chrom, pos - 20, pos + 50, 2 from var where alt = '-'
  union all select chrom, pos, pos + 40, 1 from var where alt = 'A')"""


@query("j9_annotation_overlay", f"with {SITES}, {VAR}, {OVERLAY}, best as (select s.chrom, s.pos, coalesce(max(priority), 0) as k from sites s left join spans x on x.chrom = s.chrom and s.pos >= lo and s.pos < hi group by 1, 2) select chrom, pos, case k when 3 then 'te' when 2 then 'te_boundary' when 1 then 'genic' else 'intergenic' end as label from best")
def j9(spark, d):
    v, s = variants(spark, d), sites(spark, d)
    span = lambda alt, lo, hi, k: v.where(F.col("alt") == alt).select("chrom", (F.col("pos") + lo).alias("lo"), (F.col("pos") + hi).alias("hi"), F.lit(k).alias("priority"))
    spans = span("-", 0, 30, 3).unionByName(span("-", -20, 50, 2)).unionByName(span("A", 0, 40, 1))
    hits = point_in_interval(s, spans, ["chrom"], "pos", "lo", "hi", "left", 64).groupBy("chrom", "pos").agg(F.max("priority").alias("k"))
    k = F.col("k")
    label = F.when(k == 3, "te").when(k == 2, "te_boundary").when(k == 1, "genic").otherwise("intergenic")
    return s.join(hits, ["chrom", "pos"], "left").select("chrom", "pos", label.alias("label"))


@query("j12_coordinate_lookup", f"with {SITES}, {VAR} select v.id, s.pos is not null as found from var v left join sites s on s.chrom = v.chrom and s.pos = v.pos")
def j12(spark, d):
    s = sites(spark, d).withColumn("found", F.lit(True))
    return variants(spark, d).join(s, ["chrom", "pos"], "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query("j13_variant_window", f"with {SITES}, {VAR}, w as (select chrom, pos, cast(pos // 40 as bigint) as window_id from sites) select v.id, w.window_id from var v join w on w.chrom = v.chrom and w.pos = v.pos")
def j13(spark, d):
    w = sites(spark, d).withColumn("window_id", F.expr("pos div 40"))
    return variants(spark, d).join(w, ["chrom", "pos"]).select("id", "window_id")


@query("j16_semi_join", "select c_custkey as iid from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def j16(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("iid"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("iid")).join(big, "iid", "left_semi")


@query("j17_background_anti", "select distinct l_partkey as gene, l_suppkey as line from lineitem where l_returnflag = 'N' and not exists (select 1 from lineitem f where f.l_returnflag = 'R' and f.l_partkey = lineitem.l_partkey and f.l_suppkey = lineitem.l_suppkey)")
def j17(spark, d):
    of = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("line"))
    return of("N").join(of("R"), ["gene", "line"], "left_anti").distinct()


@query("j18_missing_predictions", f"with {PAIRS}, pred as (select gene, line, avg(p) as p from pairs where p >= 15 group by 1, 2) select t.line, count(*) as n, count(case when pred.p is null then 1 end) as missing from pairs t left join pred using (gene, line) group by 1")
def j18(spark, d):
    truth = pairs(spark, d)
    pred = truth.where("p >= 15").groupBy("gene", "line").agg(F.avg("p").alias("q"))
    return truth.join(pred, ["gene", "line"], "left").groupBy("line").agg(one().alias("n"), F.count_if(F.col("q").isNull()).alias("missing"))


@query("j22_family_fallback", "select p_partkey as gene, coalesce('AT:' || case when p_size % 3 = 0 then p_brand end, 'OS:' || case when p_size % 3 = 1 then p_type end, 'SINGLETON_' || p_partkey) as family from part")
def j22(spark, d):
    best = lambda c, k: F.when(F.col("p_size") % 3 == k, F.nullif(F.col(c), F.lit("")))
    family = F.coalesce(F.concat(F.lit("AT:"), best("p_brand", 0)), F.concat(F.lit("OS:"), best("p_type", 1)), F.concat(F.lit("SINGLETON_"), F.col("p_partkey")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene"), family.alias("family"))


@query("j25_prefix_semi", f"with {SITES}, {VAR}, v as (select id, concat_ws(':', chrom, pos, ref, alt) as name from var) select id, name from v where concat_ws(':', split_part(name, ':', 1), split_part(name, ':', 2)) in (select concat_ws(':', chrom, pos) from sites)")
def j25(spark, d):
    kept = sites(spark, d).select(F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")).alias("k"))
    name = F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string"), "ref", "alt")
    v = variants(spark, d).select("id", name.alias("name"))
    return v.withColumn("k", F.substring_index("name", ":", 2)).join(kept, "k", "left_semi").select("id", "name")


@query("j21_key_compare", "with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'A') select count(a.k) filter (where b.k is not null) as shared, count(a.k) filter (where b.k is null) as only_a, count(b.k) filter (where a.k is null) as only_b from a full outer join b on a.k = b.k")
def j21(spark, d):
    keys = table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return keys.agg(F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


@query("a13_carrier_frequency", f"with {DOSAGE}, n as (select count(distinct sample) as n from dosage) select variant, round(count(*) * 1.0 / max(n), 6) as freq from dosage, n group by 1")
def a13(spark, d):
    calls = dosage(spark, d)
    total = calls.agg(F.count_distinct("sample").alias("n"))  # one row
    return calls.groupBy("variant").agg(one().alias("k")).join(F.broadcast(total)).select("variant", r6(F.col("k") / F.col("n")).alias("freq"))


@query("a46_novel_flag", f"with {DOSAGE}, t as (select variant, max(case when sample % 5 <> 0 then 1 else 0 end) as seen from dosage group by 1) select sample, bool_or(seen = 0) as novel from dosage join t using (variant) where sample % 5 = 0 group by 1")
def a46(spark, d):
    calls = dosage(spark, d)
    seen = calls.groupBy("variant").agg(F.bool_or(F.col("sample") % 5 != 0).alias("seen"))
    return calls.where("sample % 5 = 0").join(seen, "variant").groupBy("sample").agg(F.bool_or(~F.col("seen")).alias("novel"))


@query("a25_line_offset", f"with {PAIRS}, b as (select line, avg(y) as off from pairs where p < 30 group by 1) select l_orderkey, l_linenumber, round(y - coalesce(off, 0), 6) as shifted from pairs left join b using (line) where p >= 30")
def a25(spark, d):
    t = pairs(spark, d)
    off = t.where("p < 30").groupBy("line").agg(F.avg("y").alias("off"))
    return t.where("p >= 30").join(off, "line", "left").select("l_orderkey", "l_linenumber", r6(F.col("y") - F.coalesce("off", F.lit(0.0))).alias("shifted"))


@query("w8_family_split", "with f as (select p_brand as family, count(*) as size from part group by 1), c as (select family, sum(size) over (order by md5(family), family rows unbounded preceding) * 1.0 / sum(size) over () as c from f) select family, case when c <= 0.7 then 'train' when c <= 0.85 then 'val' else 'test' end as part from c")
def w8(spark, d):
    f = table(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(one().alias("size"))
    order = W.orderBy(F.md5("family"), "family").rowsBetween(W.unboundedPreceding, 0)  # one row a family
    c = F.sum("size").over(order) / F.sum("size").over(W.partitionBy())
    return f.withColumn("c", c).select("family", F.when(F.col("c") <= 0.7, "train").when(F.col("c") <= 0.85, "val").otherwise("test").alias("part"))
