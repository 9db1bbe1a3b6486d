"""Alignment, interval and as-of joins, windows, haplotypes, splits, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions import seq
from haplospark.operators.interval import nearest_marked, point_in_interval
from haplospark.operators.sampling import numbered, split_ids, stratified
from haplospark.operators.windows import greedy_windows
from haplospark.plans.base import PHENO, SITES, pheno, sites
from haplospark.plans.registry import query, table

def one():
    return F.count(F.lit(1))

GREEDY = """win as (
  select chrom, min(pos) - 25 as start, min(pos) + 25 as stop from sites group by 1
  union all
  select chrom, start, start + 50 from (
    select w.chrom, greatest(min(s.pos) - 25, w.stop) as start from win w join sites s on s.chrom = w.chrom and s.pos >= w.stop group by w.chrom, w.stop) n)"""


@query("w1_greedy_windows", f'with recursive {SITES.replace("as (", "as materialized (")}, {GREEDY} select w.chrom, cast(w.start as bigint) as start, cast(w.stop as bigint) as "end", count(*) as n_sites from win w join sites s on s.chrom = w.chrom and s.pos >= w.start and s.pos < w.stop group by 1, 2, 3')
def w1(spark, d):
    return greedy_windows(sites(spark, d), 25)


CENTRED = """win as (
  select chrom, min(pos) as p from sites group by 1
  union all
  select chrom, p from (select w.chrom, min(s.pos) as p from win w join sites s on s.chrom = w.chrom and s.pos > w.p + 20 group by w.chrom, w.p) n)"""


@query("w2_overlap_windows", f'with recursive {SITES.replace("as (", "as materialized (")}, {CENTRED} select w.chrom, cast(w.p - 25 as bigint) as start, cast(w.p + 25 as bigint) as "end", count(*) as n_sites from win w join sites s on s.chrom = w.chrom and s.pos between w.p and w.p + 20 group by 1, 2, 3')
def w2(spark, d):
    return greedy_windows(sites(spark, d), 25, "overlap", 5)


@query("j3_site_windows", f"with {SITES}, w as (select distinct chrom, (pos // 40) * 40 - 7 as start, (pos // 40) * 40 + 29 as stop from sites) select s.chrom, s.pos, w.start from sites s join w on s.chrom = w.chrom and s.pos >= w.start and s.pos < w.stop")
def j3(spark, d):
    s = sites(spark, d)
    low = F.floor(F.col("pos") / 40) * 40
    w = s.select("chrom", (low - 7).alias("start"), (low + 29).alias("stop")).distinct()
    return point_in_interval(s, w, ["chrom"], "pos", "start", "stop", "left", 64).select("chrom", "pos", "start")


@query("j6_span_counts", f"with {SITES}, g as (select p_partkey as gene, 1 + p_partkey % 7 as chrom, p_partkey * 3 as lo, p_partkey * 3 + p_size as hi from part) select g.gene, count(*) as n from g join sites s on s.chrom = g.chrom and s.pos between g.lo - 10 and g.hi + 10 group by 1")
def j6(spark, d):
    key = F.col("p_partkey")
    g = table(spark, d, "part").select(key.alias("gene"), (1 + key % 7).cast("int").alias("chrom"), (key * 3 - 10).alias("lo"), (key * 3 + F.col("p_size") + 10).alias("hi"))
    return point_in_interval(sites(spark, d), g, ["chrom"], "pos", "lo", "hi", "both", 64).groupBy("gene").agg(one().alias("n"))


@query("j1_align_phenotypes", f"with {PHENO} select s.s_suppkey as sample, s.s_suppkey - 1 as sample_ord, p.value from supplier s left join pheno p on p.iid = s.s_suppkey")
def j1(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") - 1).alias("sample_ord"))
    return s.join(pheno(spark, d).select(F.col("iid").alias("sample"), "value"), "sample", "left")


@query("j10_nearest_mapped", f"""with {SITES}, m as (select *, case when pos % 10 = 0 then pos end as mapped from sites),
n as (select chrom, pos, last_value(mapped ignore nulls) over (partition by chrom order by pos rows between unbounded preceding and current row) as back,
  first_value(mapped ignore nulls) over (partition by chrom order by pos rows between current row and unbounded following) as ahead from m)
select chrom, pos, case when back is null then ahead when ahead is null or pos - back <= ahead - pos then back else ahead end as nearest from n""")
def j10(spark, d):
    return nearest_marked(sites(spark, d), F.col("pos") % 10 == 0)


@query("j15_id_overlap", "select coalesce(c.c_custkey, o.k) as id, c.c_custkey is not null as in_a, o.k is not null as in_b from (select c_custkey from customer where c_acctbal > 0) c full outer join (select distinct o_custkey as k from orders) o on c.c_custkey = o.k")
def j15(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("in_a"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("in_b", F.lit(True))
    return a.join(b, "id", "full").na.fill(False, ["in_a", "in_b"])


@query("j24_prior_weights", f"with {PHENO}, w as (select iid, value / avg(value) over () as w from pheno where value > 0) select p.iid, round(coalesce(w, 1.0), 6) as weight from pheno p left join w using (iid)")
def j24(spark, d):
    p = pheno(spark, d)
    known = p.where("value > 0")
    mean = known.agg(F.avg("value").alias("mean"))
    w = known.join(F.broadcast(mean)).select("iid", (F.col("value") / F.col("mean")).alias("w"))
    return p.select("iid").join(w, "iid", "left").select("iid", F.round(F.coalesce("w", F.lit(1.0)), 6).alias("weight"))


HAPS = """calls as (select distinct l_suppkey as sample, l_partkey // 25 as window_id, l_partkey as pos from lineitem where l_returnflag = 'R'),
spine as (select s, w from (select distinct l_suppkey as s from lineitem) a, (select distinct l_partkey // 25 as w from lineitem) b),
fp as (select s as sample, w as window_id, coalesce(string_agg(cast(pos as varchar), ',' order by pos), '') as alts from spine left join calls on s = sample and w = window_id group by 1, 2)"""


def _haplotypes(spark, d):
    """(window_id, alts, first_ord, multiplicity) of each distinct haplotype, samples numbered from 0 in order.

    Samples without an alternative allele are never written out: a window's
    all-reference haplotype has the samples left over, and the first of them is the
    count of carriers whose number equals their rank.
    """
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.expr("l_partkey div 25").alias("window_id"), F.col("l_partkey").alias("pos"), "l_returnflag")
    ords = numbered(li, "sample")
    total = ords.agg(one().alias("samples"))  # one row
    alts = li.where("l_returnflag = 'R'").groupBy("sample", "window_id").agg(F.array_join(F.array_sort(F.collect_set("pos")), ",").alias("alts"))
    carriers = alts.join(ords, "sample").withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("ord")) - 1)
    carried = carriers.groupBy("window_id", "alts").agg(
        F.min("ord").alias("first_ord"), one().alias("multiplicity"), F.count_if(F.col("ord") == F.col("rank")).alias("in_place")
    )
    used = carried.groupBy("window_id").agg(F.sum("multiplicity").alias("n"), F.sum("in_place").alias("first_ord"))
    rest = li.select("window_id").distinct().join(used, "window_id", "left").na.fill(0).join(F.broadcast(total)).where("n < samples")
    rest = rest.select("window_id", F.lit("").alias("alts"), "first_ord", (F.col("samples") - F.col("n")).alias("multiplicity"))
    return carried.drop("in_place").unionByName(rest)


@query("a9_fingerprints", f"with {HAPS}, o as (select s, row_number() over (order by s) - 1 as ord from (select distinct s from spine)), u as (select window_id, alts, min(ord) as first_ord from fp join o on s = sample group by 1, 2) select window_id, alts, row_number() over (partition by window_id order by first_ord) - 1 as fp_no, first_ord from u")
def a9(spark, d):
    fp_no = F.row_number().over(W.partitionBy("window_id").orderBy("first_ord")) - 1
    return _haplotypes(spark, d).select("window_id", "alts", fp_no.alias("fp_no"), "first_ord")


@query("a8_haplotype_counts", f"with {HAPS} select window_id, alts, count(*) as multiplicity from fp group by 1, 2")
def a8(spark, d):
    return _haplotypes(spark, d).select("window_id", "alts", "multiplicity")


@query("a10_unique_windows", f"with {HAPS} select window_id, count(distinct alts) as n_unique from fp group by 1")
def a10(spark, d):
    return _haplotypes(spark, d).groupBy("window_id").agg(one().alias("n_unique"))


@query("t2_split", "with r as (select c_custkey as id, c_mktsegment as trait, row_number() over (partition by c_mktsegment order by md5(concat(cast(c_custkey as varchar), '-42')), c_custkey) as rn, count(*) over (partition by c_mktsegment) as n from customer) select id, trait, case when rn <= round_even(n * 0.15, 0) then 'val' when rn <= round_even(n * 0.3, 0) then 'test' else 'train' end as part from r")
def t2(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("trait"))
    return split_ids(ids, "id", 42, {"val": 0.15, "test": 0.15}, ["trait"])


@query("o7_stratified_sample", "with r as (select o_orderkey as id, o_orderpriority as stratum, row_number() over (partition by o_orderpriority order by md5(concat(cast(o_orderkey as varchar), '-3')), o_orderkey) as rn from orders) select id, stratum from r where rn <= 50")
def o7(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"))
    return stratified(o, ["stratum"], "id", 50, 3)


@query("w11_keep_first", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) where rn = 1")
def w11(spark, d):
    first = F.row_number().over(W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("rn", first).where("rn = 1").select("l_partkey", "l_orderkey", "l_linenumber")


@query("w9_replicates", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as rep from orders")
def w9(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("rep"))


@query("r1_pivot", f"with {PHENO} select grp, round(avg(case when trait = 'BUILDING' then value end), 4) as building, round(avg(case when trait = 'MACHINERY' then value end), 4) as machinery from pheno group by 1")
def r1(spark, d):
    wide = pheno(spark, d).groupBy("grp").pivot("trait", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("value"), 4))
    return wide.withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("r4_unpivot", "select l_orderkey, l_linenumber, 'quantity' as trait, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'discount', l_discount from lineitem")
def r4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount"], "trait", "value")


@query("r2_row_spine", "with m as (select o_custkey as iid, count(*) as n from orders group by 1) select iid, rep from m, range(0, (select max(n) from m)) t(rep) where rep < n")
def r2(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("iid")).agg(one().alias("n"))
    return m.select("iid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rep"))


@query("u2_intersect", "select c_nationkey as id from customer intersect select s_nationkey from supplier")
def u2(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("id")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("u3_except", "select c_custkey as id from customer except select o_custkey from orders")
def u3(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


SEQ = "upper(regexp_replace(md5(cast(p_partkey as varchar)), '[^acdef]', 'n', 'g'))"


@query("f2_reverse_complement", f"select p_partkey, reverse(translate({SEQ}, 'ACGTNacgtn', 'TGCANtgcan')) as rc, translate({SEQ}, 'ACGT', 'TGCA') as comp from part")
def f2(spark, d):
    s = F.upper(F.regexp_replace(F.md5(F.col("p_partkey").cast("string")), "[^acdef]", "n"))
    return table(spark, d, "part").select("p_partkey", seq.reverse_complement(s).alias("rc"), seq.complement(s).alias("comp"))


@query("f10_context_code", "with b as (select l_orderkey, l_linenumber, l_returnflag as x, l_linestatus as y from lineitem) select l_orderkey, l_linenumber, case when x = 'N' or (y = 'N' and x <> 'G') then 0 when x = 'G' then 1 when y = 'G' then 2 else 3 end as code from b")
def f10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", seq.context_code(F.col("l_returnflag"), F.col("l_linestatus")).alias("code"))


@query("a35_kmer_entropy", "with p as (select text, unnest(range(0, length(text) // 6)) as i from documents), k as (select substr(text, i * 6 + 1, 6) as kmer from p), c as (select kmer, count(*) as n from k group by 1) select round(-sum(n * 1.0 / t * ln(n * 1.0 / t)), 4) as entropy, sum(n)::bigint as kmers, count(*) as distinct_kmers from c, (select sum(n) as t from c)")
def a35(spark, d):
    docs = table(spark, d, "documents").where("length(text) >= 6")
    c = docs.select(F.explode(seq.kmers(F.col("text"), 6, 6)).alias("kmer")).groupBy("kmer").agg(one().alias("n"))
    # -sum(p ln p) = ln t - sum(n ln n) / t, so one pass of sums will do
    n = F.col("n")
    return c.agg(F.round(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n), 4).alias("entropy"), F.sum(n).alias("kmers"), one().alias("distinct_kmers"))


@query("a36_sequence_stats", "select doc_id, length(text) as length, length(text) - length(replace(text, 'n', '')) as n_count, length(regexp_replace(text, '[^a-z]', '', 'g')) as soft_masked, round(length(regexp_replace(upper(text), '[^GC]', '', 'g')) * 1.0 / nullif(length(regexp_replace(upper(text), '[^ACGT]', '', 'g')), 0), 6) as gc from documents")
def a36(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.length(t).cast("long").alias("length"), (F.length(t) - F.length(F.replace(t, F.lit("n"), F.lit("")))).cast("long").alias("n_count"),
        F.length(F.regexp_replace(t, "[^a-z]", "")).cast("long").alias("soft_masked"), F.round(seq.gc_fraction(t), 6).alias("gc"),
    )


@query("a16_window_means", "with e as (select label as win, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select win, dim, round(avg(x), 5) as mean, round(avg(cast(x as double) * x) - avg(cast(x as double)) * avg(cast(x as double)), 5) as var from e group by 1, 2")
def a16(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("win"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("win", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.avg(F.col("x") * F.col("x")) - F.pow(F.avg("x"), 2), 5).alias("var"))


@query("f21_vector_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) as norm from embeddings")
def f21(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(seq.norm(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("norm"))


@query("x4_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def x4(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(one().alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )
