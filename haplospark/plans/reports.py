"""Pooled and sliced reports, ordered picks, resampling, scalars and per-group fits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions import seq
from haplospark.operators.ranking import row_numbers
from haplospark.operators.sampling import draw_key
from haplospark.plans.base import PHENO, pheno
from haplospark.plans.registry import query, table
from haplospark.plans.variants import PAIRS, VAR, one, pairs, r6, variants


@query("a31_variance_by_bucket", "with z as (select least(l_linenumber, 3) as bucket, l_extendedprice / 1000 as z, l_returnflag = 'R' as focus from lineitem) select bucket, round(var_pop(z) filter (where focus) / nullif(var_pop(z) filter (where not focus), 0), 6) as ratio, count(*) filter (where focus) as n_focus from z group by 1")
def a31(spark, d):
    z, focus = F.col("l_extendedprice") / 1000, F.col("l_returnflag") == "R"
    ratio = F.var_pop(F.when(focus, z)) / F.nullif(F.var_pop(F.when(~focus, z)), F.lit(0.0))
    return table(spark, d, "lineitem").groupBy(F.least("l_linenumber", F.lit(3)).alias("bucket")).agg(r6(ratio).alias("ratio"), F.count_if(focus).alias("n_focus"))


@query("a37_between_within", f"with {PHENO}, g as (select trait, grp, count(value) as n, avg(value) as m, var_pop(value) as v from pheno where value is not null group by 1, 2), t as (select trait, avg(value) as gm from pheno group by 1) select trait, round(sum(n * (m - gm) * (m - gm)) / sum(n * (m - gm) * (m - gm) + n * v), 6) as between_share from g join t using (trait) group by 1")
def a37(spark, d):
    p = pheno(spark, d).where("value is not null")
    g = p.groupBy("trait", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    own = W.partitionBy("trait")
    gm = F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own)
    g = g.withColumn("between", F.col("n") * F.pow(F.col("m") - gm, 2))
    return g.groupBy("trait").agg(r6(F.sum("between") / F.sum(F.col("between") + F.col("n") * F.col("v"))).alias("between_share"))


@query("a38_match_rate", f"with {VAR} select chrom, count(*) as n, round(avg(case when alt = ref then 1.0 else 0.0 end), 6) as rate from var group by rollup (chrom)")
def a38(spark, d):
    return variants(spark, d).rollup("chrom").agg(one().alias("n"), r6(F.avg((F.col("alt") == F.col("ref")).cast("double"))).alias("rate"))


@query("a39_best_run", "with b as (select o_custkey, o_orderpriority, max(o_totalprice) as best from orders group by 1, 2) select o_orderpriority, count(*) as groups, round(avg(best), 4) as mean_best from b group by 1")
def a39(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("best"))
    return best.groupBy("o_orderpriority").agg(one().alias("groups"), F.round(F.avg("best"), 4).alias("mean_best"))


@query("a40_binned_mean", "with c as (select l_orderkey, count(*) as n, avg(l_quantity) as q from lineitem group by 1) select case when n <= 2 then '1-2' when n <= 4 then '3-4' else '5+' end as bin, count(*) as size, round(avg(q), 6) as mean from c group by 1")
def a40(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(one().alias("n"), F.avg("l_quantity").alias("q"))
    label = F.when(F.col("n") <= 2, "1-2").when(F.col("n") <= 4, "3-4").otherwise("5+")
    return c.groupBy(label.alias("bin")).agg(one().alias("size"), r6(F.avg("q")).alias("mean"))


@query("a41_norm_summary", "with e as (select label, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm from embeddings) select label, count(*) as n, round(avg(norm), 4) as mean, round(quantile_cont(norm, 0.5), 4) as median, round(max(norm), 4) as most from e group by 1")
def a41(spark, d):
    e = table(spark, d, "embeddings").select("label", seq.norm(F.transform("embedding", lambda x: x.cast("double"))).alias("norm"))
    return e.groupBy("label").agg(
        one().alias("n"), F.round(F.avg("norm"), 4).alias("mean"), F.round(F.percentile("norm", F.lit(0.5)), 4).alias("median"), F.round(F.max("norm"), 4).alias("most")
    )


@query("a42_probe_percentiles", "with c as (select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2) select l_suppkey, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90, max(n) as most from c group by 1")
def a42(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(one().alias("n"))
    at = lambda q: r6(F.percentile("n", F.lit(q)))
    return c.groupBy("l_suppkey").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("most"))


@query("a43_profile_outliers", f"with {PAIRS}, m as (select *, avg(y) over (partition by gene) as mean from pairs) select line, count(*) as n, round(corr(y, mean), 6) as r, corr(y, mean) < 0.8 as outlier from m group by 1")
def a43(spark, d):
    m = pairs(spark, d).withColumn("mean", F.avg("y").over(W.partitionBy("gene")))
    r = F.corr("y", "mean")
    return m.groupBy("line").agg(one().alias("n"), r6(r).alias("r"), (r < 0.8).alias("outlier"))


@query("a45_sliced_pearson", f"with {PAIRS}, s as (select y, p, gene % 3 = 0 as novel from pairs) select novel, count(*) as n, round(corr(y, p), 6) as r, round(1 / sqrt(count(*)), 6) as se from s group by rollup (novel) having count(*) >= 30")
def a45(spark, d):
    s = pairs(spark, d).withColumn("novel", F.col("gene") % 3 == 0)
    out = s.rollup("novel").agg(one().alias("n"), F.corr("y", "p").alias("r")).where("n >= 30")
    return out.select("novel", "n", r6("r").alias("r"), r6(1 / F.sqrt("n")).alias("se"))


@query("a47_paired_gap", f"with {PAIRS}, g as (select line, gene, avg(y) - avg(p) as gap from pairs group by 1, 2) select line, round(avg(gap), 5) as mean, round(quantile_cont(gap, 0.5), 5) as median, round(quantile_cont(abs(gap), 0.95), 5) as p95 from g group by 1")
def a47(spark, d):
    g = pairs(spark, d).groupBy("line", "gene").agg((F.avg("y") - F.avg("p")).alias("gap"))
    r5 = lambda c: F.round(c, 5)
    return g.groupBy("line").agg(r5(F.avg("gap")).alias("mean"), r5(F.percentile("gap", F.lit(0.5))).alias("median"), r5(F.percentile(F.abs("gap"), F.lit(0.95))).alias("p95"))


@query("a50_site_summary", f"with {PHENO} select trait, count(*) as n, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(coalesce(value, 0), 0.5), 4) as zero_median, round(avg(case when value > 0.3 then 1.0 else 0.0 end), 6) as above from pheno group by 1")
def a50(spark, d):
    v = F.col("value")
    return pheno(spark, d).groupBy("trait").agg(
        one().alias("n"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(F.coalesce(v, F.lit(0.0)), F.lit(0.5)), 4).alias("zero_median"),
        r6(F.avg(F.when(v > 0.3, 1.0).otherwise(0.0))).alias("above"),
    )


@query("a52_activation_stats", "with e as (select label, unnest(embedding)::double as x from embeddings) select label, round(avg(x), 5) as mean, round(stddev_samp(x), 5) as sd, round(max(abs(x)), 5) as absmax, round(avg(case when x = 0 then 1.0 else 0.0 end), 6) as zero from e group by 1")
def a52(spark, d):
    e = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("label").agg(
        F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_samp("x"), 5).alias("sd"), F.round(F.max(F.abs("x")), 5).alias("absmax"),
        r6(F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0))).alias("zero"),
    )


@query("w10_pick_with_alternates", "with r as (select l_partkey, l_orderkey * 10 + l_linenumber as gsm, row_number() over (partition by l_partkey order by l_returnflag <> 'R', l_orderkey * 10 + l_linenumber) as rn from lineitem) select l_partkey, max(case when rn = 1 then gsm end) as gsm, coalesce(string_agg(cast(gsm as varchar), ';' order by gsm) filter (where rn > 1), '') as alternates from r group by 1")
def w10(spark, d):
    gsm = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    r = table(spark, d, "lineitem").select("l_partkey", gsm.alias("gsm"), (F.col("l_returnflag") != "R").alias("other"))
    r = r.withColumn("rn", F.row_number().over(W.partitionBy("l_partkey").orderBy("other", "gsm")))
    rest = F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col("gsm")))), ";")
    return r.groupBy("l_partkey").agg(F.max(F.when(F.col("rn") == 1, F.col("gsm"))).alias("gsm"), rest.alias("alternates"))


@query("w12_argmax", "select o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) as best from orders group by 1")
def w12(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.col("o_totalprice") * 1000000 + F.col("o_orderkey")).alias("best"))


@query("w13_rank_weights", "select c_custkey, round((row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) - 1) * 1.0 / greatest(count(*) over (partition by c_nationkey) - 1, 1), 6) as weight from customer")
def w13(spark, d):
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")) - 1
    n = one().over(W.partitionBy("c_nationkey")) - 1
    return table(spark, d, "customer").select("c_custkey", r6(rank / F.greatest(n, F.lit(1))).alias("weight"))


@query("w21_last_logged", "select event_type, max_by(value, event_id) as last_value, max(value) as best from events group by 1")
def w21(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.max("value").alias("best"))


@query("o2_top_covariance", f"with {PAIRS}, c as (select gene, covar_pop(y, p) as c from pairs group by 1), k as (select gene, round(abs(c), 6) as c, row_number() over (order by round(abs(c), 6) desc, gene) as rn from c) select gene, c from k where rn <= 100")
def o2(spark, d):
    c = pairs(spark, d).groupBy("gene").agg(r6(F.abs(F.covar_pop("y", "p"))).alias("c"))
    return c.orderBy(F.desc("c"), "gene").limit(100)


@query("o6_uniform_sample", "select p_partkey as gene from part order by md5(concat(cast(p_partkey as varchar), '-9')), p_partkey limit 64")
def o6(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene"))
    return genes.orderBy(F.md5(F.concat(F.col("gene").cast("string"), F.lit("-9"))), "gene").limit(64)


@query("t9_stratified_folds", "select c_custkey, (row_number() over (partition by c_mktsegment order by md5(concat(cast(c_custkey as varchar), '-5')), c_custkey) - 1) % 5 as fold from customer")
def t9(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return row_numbers(rows, ["c_mktsegment"], [draw_key("c_custkey", 5), "c_custkey"]).select("c_custkey", ((F.col("rn") - 1) % 5).alias("fold"))


@query("t10_permuted_targets", f"with {PHENO}, a as (select iid, trait, row_number() over (partition by trait order by iid) as rn from pheno), b as (select value, trait, row_number() over (partition by trait order by md5(concat(cast(iid as varchar), '-1')), iid) as rn from pheno) select a.iid, b.value from a join b using (trait, rn)")
def t10(spark, d):
    p = pheno(spark, d)
    a = row_numbers(p.select("iid", "trait"), ["trait"], ["iid"])
    b = row_numbers(p.select("iid", "value", "trait"), ["trait"], [draw_key("iid", 1), "iid"]).drop("iid")
    return a.join(b, ["trait", "rn"]).select("iid", "value")


@query("r3_weighted_expansion", "select l_orderkey, l_linenumber, unnest(range(0, cast(l_linenumber as bigint))) as copy from lineitem")
def r3(spark, d):
    copies = F.sequence(F.lit(0).cast("long"), F.col("l_linenumber").cast("long") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(copies).alias("copy"))


@query("r5_one_hot", f"with {VAR} select id, cast(alt = 'A' as integer) as a, cast(alt = 'C' as integer) as c, cast(alt = 'G' as integer) as g, cast(alt = 'T' as integer) as t from var")
def r5(spark, d):
    return variants(spark, d).select("id", *[(F.col("alt") == b).cast("int").alias(b.lower()) for b in "ACGT"])


@query("f6_kmer_ids", "with k as (select p_partkey, upper(translate(substr(md5(cast(p_partkey as varchar)), 1, 6), '0123456789abcdef', 'acgtacgtacgtacgn')) as kmer from part) select p_partkey, case when contains(kmer, 'N') then 151671 else 151672 + list_sum(list_transform(range(1, 7), lambda i: (strpos('ATCG', substr(kmer, i, 1)) - 1) * cast(pow(4, 6 - i) as bigint)))::bigint end::bigint as token from k")
def f6(spark, d):
    digest = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)
    kmer = F.upper(F.translate(digest, "0123456789abcdef", "acgtacgtacgtacgn"))
    return table(spark, d, "part").select("p_partkey", seq.kmer_id(kmer).cast("long").alias("token"))


@query("f13_chrom_split", f"with {VAR} select id, case when chrom = 4 then 'val' when chrom = 5 then 'test' else 'train' end as part from var")
def f13(spark, d):
    return variants(spark, d).select("id", F.when(F.col("chrom") == 4, "val").when(F.col("chrom") == 5, "test").otherwise("train").alias("part"))


@query("f15_log_transforms", "select l_orderkey, l_linenumber, round(log2(1 + l_quantity), 6) as log2_expr, round(ln(1 + abs(l_tax)), 6) as log1p from lineitem")
def f15(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.log2(1 + F.col("l_quantity"))).alias("log2_expr"), r6(F.log1p(F.abs("l_tax"))).alias("log1p"))


@query("f25_config_hash", "select p_partkey, substr(sha1(concat('{\"brand\":\"', p_brand, '\",\"size\":', cast(p_size as varchar), '}')), 1, 10) as config from part")
def f25(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha1(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))), 1, 10).alias("config"))


@query("f26_warmup_cosine", "select l_orderkey, l_linenumber, round(case when l_quantity < 10 then l_quantity / 10 else 0.5 * (1 + cos(pi() * (l_quantity - 10) / 40)) end, 6) as rate from lineitem")
def f26(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.when(q < 10, q / 10).otherwise(0.5 * (1 + F.cos(F.pi() * (q - 10) / 40)))).alias("rate"))


@query("m1_ridge_by_group", f"with {PAIRS}, s as (select line, count(*) as n, avg(p) as mp, avg(y) as my, covar_pop(p, y) * count(*) as sxy, var_pop(p) * count(*) as sxx from pairs group by 1) select line, n, round(sxy / (sxx + 1.0), 5) as slope, round(my - mp * sxy / (sxx + 1.0), 5) as intercept from s where n >= 20")
def m1(spark, d):
    """Ridge of one feature with a free intercept, penalty 1, by normal equations: sums that merge map-side."""
    n = one()
    s = pairs(spark, d).groupBy("line").agg(
        n.alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), (F.covar_pop("p", "y") * n).alias("sxy"), (F.var_pop("p") * n).alias("sxx")
    )
    slope = F.col("sxy") / (F.col("sxx") + 1.0)
    return s.where("n >= 20").select("line", "n", F.round(slope, 5).alias("slope"), F.round(F.col("my") - F.col("mp") * slope, 5).alias("intercept"))
