"""Site accumulators, allele statistics, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.ranking import average_ranks, row_numbers
from haplospark.operators.stats import masked_metrics, with_train_zscore, with_zscore
from haplospark.operators.stored import stored
from haplospark.operators.windows import near_counts
from haplospark.plans.base import ALLC, DOSAGE, PHENO, allc, dosage, pheno
from haplospark.plans.registry import query, table
from haplospark.streaming.accumulate import merge_accumulators, site_accumulators

def one():
    return F.count(F.lit(1))


def r6(c):
    return F.round(c, 6)


ACC = """acc as (select site, count(case when total >= 2 then 1 end) as n_obs, sum(case when total >= 2 then mc * 1.0 / total end) as sum_p,
  sum(case when total >= 2 then (mc * 1.0 / total) * (mc * 1.0 / total) end) as sum_p2,
  sum(case when total >= 2 then (mc * 1.0 / total) * (1 - mc * 1.0 / total) / greatest(total - 1, 1) end) as sum_noise,
  sum(mc) as sum_m, sum(total) as sum_total, count(*) as n_seen from allc group by 1)"""


@query("a1_site_accumulators", f"with {ALLC}, {ACC} select site, n_obs, round(sum_p, 6) as sum_p, round(sum_p2, 6) as sum_p2, round(sum_noise, 6) as sum_noise, cast(sum_m as bigint) as sum_m, cast(sum_total as bigint) as sum_total, n_seen from acc")
def a1(spark, d):
    return site_accumulators(allc(spark, d, ("site",)).select("site", "mc", "total")).withColumns({c: r6(c) for c in ("sum_p", "sum_p2", "sum_noise")})


@query("k6_merged_partials", f"with {ALLC}, {ACC} select site, n_obs, round(sum_p, 6) as sum_p, round(sum_p2, 6) as sum_p2, round(sum_noise, 6) as sum_noise, cast(sum_m as bigint) as sum_m, cast(sum_total as bigint) as sum_total, n_seen from acc")
def k6(spark, d):
    """Site accumulators kept by chromosome and merged."""
    calls = allc(spark, d, ("site",))
    partials = stored(site_accumulators(calls.select("chrom", "site", "mc", "total"), by=("chrom", "site")))
    return merge_accumulators(partials).withColumns({c: r6(c) for c in ("sum_p", "sum_p2", "sum_noise")})


@query("a3_first_context", "select l_partkey as site, min_by(l_returnflag, l_orderkey * 10 + l_linenumber) as context, count(distinct l_returnflag) > 1 as changed from lineitem group by 1")
def a3(spark, d):
    """The context of a site's first call, of equal calls the one that the files have first, and whether others differ. Calls without one do not count."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    place = F.when(F.col("l_returnflag").isNotNull() & key.isNotNull(), F.struct(key.alias("key"), "_metadata.file_path", "_metadata.row_index"))
    calls = table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), "l_returnflag", place.alias("place"))
    return calls.groupBy("site").agg(F.min_by("l_returnflag", "place").alias("context"), (F.count_distinct("l_returnflag") > 1).alias("changed"))


@query("a4_window_binomial", f"with {ALLC}, w as (select accession, chrom, site // 100 as win, sum(mc) as m, sum(total) as t from allc group by 1, 2, 3 having sum(total) >= 10) select chrom, win, count(*) as n, round(avg(m * 1.0 / t), 6) as mean_p, round(var_pop(m * 1.0 / t), 6) as var_p from w group by 1, 2")
def a4(spark, d):
    level = F.col("m") / F.col("t")
    per = allc(spark, d).groupBy("accession", "chrom", F.floor(F.col("site") / 100).alias("win")).agg(F.sum("mc").alias("m"), F.sum("total").alias("t")).where("t >= 10")
    return per.groupBy("chrom", "win").agg(one().alias("n"), r6(F.avg(level)).alias("mean_p"), r6(F.var_pop(level)).alias("var_p"))


@query("a5_file_qc", f"with {ALLC} select accession, count(*) as n_rows, count(distinct chrom) as n_chroms, max(site) as max_pos, round(avg(total), 6) as mean_cov, round(sum(case when context = 'R' then mc end) * 1.0 / nullif(sum(case when context = 'R' then total end), 0), 6) as level_r from allc group by 1")
def a5(spark, d):
    own = F.col("context") == "R"
    level = F.sum(F.when(own, F.col("mc"))) / F.nullif(F.sum(F.when(own, F.col("total"))), F.lit(0))
    return allc(spark, d).groupBy("accession").agg(
        one().alias("n_rows"), F.count_distinct("chrom").alias("n_chroms"), F.max("site").alias("max_pos"), r6(F.avg("total")).alias("mean_cov"), r6(level).alias("level_r")
    )


@query("a6_a7_retained_sites", f"with {ALLC}, {ACC}, m as (select site, n_obs, sum_p / n_obs as mean_p, sum_p2 / n_obs - (sum_p / n_obs) * (sum_p / n_obs) as var_obs, sum_noise / n_obs as noise from acc where n_obs > 0) select site, n_obs, round(mean_p, 6) as mean_p, round(var_obs, 6) as var_obs, round(noise, 6) as noise from m where n_obs >= 5 and var_obs > 1.5 * noise")
def a6(spark, d):
    n = F.col("n_obs")
    moments = site_accumulators(allc(spark, d, ("site",)).select("site", "mc", "total")).where(n > 0).select(
        "site", "n_obs", (F.col("sum_p") / n).alias("mean_p"), (F.col("sum_p2") / n - F.pow(F.col("sum_p") / n, 2)).alias("var_obs"), (F.col("sum_noise") / n).alias("noise")
    )
    return moments.where("n_obs >= 5 and var_obs > 1.5 * noise").withColumns({c: r6(c) for c in ("mean_p", "var_obs", "noise")})


@query("a12_allele_frequency", f"with {DOSAGE} select variant, count(*) as n, round(avg(dosage) / 2, 6) as af, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) as maf from dosage group by 1")
def a12(spark, d):
    af = F.avg("dosage") / 2
    return dosage(spark, d).groupBy("variant").agg(one().alias("n"), r6(af).alias("af"), r6(F.least(af, 1 - af)).alias("maf"))


@query("p3_variant_qc", f"with {DOSAGE}, n as (select count(distinct sample) as samples from dosage) select variant, round(1 - count(*) * 1.0 / max(samples), 6) as missing, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) as maf from dosage, n group by 1 having count(*) * 1.0 / max(samples) >= 0.1 and least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.01")
def p3(spark, d):
    calls = dosage(spark, d)
    af = F.avg("dosage") / 2
    stats = calls.groupBy("variant").agg(one().alias("n"), F.least(af, 1 - af).alias("maf"))
    total = calls.agg(F.count_distinct("sample").alias("samples"))
    rate = F.col("n") / F.col("samples")
    return stats.join(F.broadcast(total)).where((rate >= 0.1) & (F.col("maf") >= 0.01)).select("variant", r6(1 - rate).alias("missing"), r6("maf").alias("maf"))


@query("a11_sites_per_window", "with w as (select l_linenumber as chrom, l_partkey // 50 as win, count(distinct l_partkey) as n from lineitem group by 1, 2) select chrom, count(*) as windows, sum(n)::bigint as total, round(avg(n), 6) as mean, round(quantile_cont(n, 0.5), 6) as median, max(n) as most, min(n) as least from w group by 1")
def a11(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("chrom"), F.floor(F.col("l_partkey") / 50).alias("win")).agg(F.count_distinct("l_partkey").alias("n"))
    return per.groupBy("chrom").agg(
        one().alias("windows"), F.sum("n").alias("total"), r6(F.avg("n")).alias("mean"), r6(F.percentile("n", F.lit(0.5))).alias("median"), F.max("n").alias("most"), F.min("n").alias("least")
    )


@query("a19_duplicate_average", f"with {PHENO} select grp, trait, count(value) as n, round(avg(value), 4) as mean from pheno group by 1, 2")
def a19(spark, d):
    return pheno(spark, d).groupBy("grp", "trait").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("a20_grm", f"with {DOSAGE}, v as (select variant, avg(dosage) as m, stddev_pop(dosage) as s from dosage group by 1 having stddev_pop(dosage) > 0), z as (select sample, variant, (dosage - m) / s as z from dosage join v using (variant)) select a.sample as i, b.sample as j, round(sum(a.z * b.z), 4) as k, count(*) as shared from z a join z b on a.variant = b.variant and a.sample <= b.sample group by 1, 2")
def a20(spark, d):
    calls = dosage(spark, d)
    stats = calls.groupBy("variant").agg(F.avg("dosage").alias("m"), F.stddev_pop("dosage").alias("s")).where("s > 0")
    z = calls.join(stats, "variant").select("sample", "variant", ((F.col("dosage") - F.col("m")) / F.col("s")).alias("z"))
    a, b = z.select("variant", F.col("sample").alias("i"), F.col("z").alias("za")), z.select("variant", F.col("sample").alias("j"), F.col("z").alias("zb"))
    return a.join(b, "variant").where("i <= j").groupBy("i", "j").agg(F.round(F.sum(F.col("za") * F.col("zb")), 4).alias("k"), one().alias("shared"))


@query("a21_coverage_table", f"with {PHENO} select trait, count(distinct case when value is not null then iid end) as accessions, count(*) as n from pheno group by 1")
def a21(spark, d):
    return pheno(spark, d).groupBy("trait").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("iid"))).alias("accessions"), one().alias("n"))


@query("a22_group_deviation", f"with {PHENO} select iid, round(value - avg(value) over (partition by trait), 4) as deviation from pheno")
def a22(spark, d):
    means = pheno(spark, d).groupBy("trait").agg(F.avg("value").alias("m"))
    return pheno(spark, d).join(means, "trait").select("iid", F.round(F.col("value") - F.col("m"), 4).alias("deviation"))


@query("a24_carrier_counts", f"with {DOSAGE}, c as (select *, count(*) over (partition by variant) as ac from dosage) select sample, count(*) as carried, count(case when ac <= 8 then 1 end) as rare from c group by 1")
def a24(spark, d):
    c = dosage(spark, d).withColumn("ac", one().over(W.partitionBy("variant")))
    return c.groupBy("sample").agg(one().alias("carried"), F.count(F.when(F.col("ac") <= 8, 1)).alias("rare"))


METRIC = "m as (select l_linenumber as grp, case when l_partkey % 11 = 0 then null else l_extendedprice / 1000 end as t, l_quantity * 1.5 as p from lineitem)"


@query("a26_masked_metrics", f"with {METRIC}, k as (select * from m where t is not null and p is not null) select grp, count(*) as n, round(corr(t, p), 6) as pearson, round(1 - sum((t - p) * (t - p)) / nullif(var_pop(t) * count(*), 0), 6) as r2, round(avg((t - p) * (t - p)), 4) as mse, round(avg(abs(t - p)), 6) as mae from k group by 1")
def a26(spark, d):
    m = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("grp"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_quantity") * 1.5).alias("p")
    )
    out = masked_metrics(m, ["grp"], "t", "p")
    return out.withColumns({"pearson": r6("pearson"), "r2": r6("r2"), "mse": F.round("mse", 4), "mae": r6("mae")})


@query("a27_token_nll", "select lang, count(*) as n, round(sum(n_chars * 0.7) / sum(n_chars), 6) as nats, round(exp(sum(n_chars * 0.7) / sum(n_chars)), 6) as perplexity, round(sum(n_chars * 0.7) / sum(n_chars) / 6 / ln(2), 6) as bits_per_base from documents group by 1")
def a27(spark, d):
    nats = F.sum(F.col("n_chars") * 0.7) / F.sum("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(one().alias("n"), r6(nats).alias("nats"), r6(F.exp(nats)).alias("perplexity"), r6(nats / 6 / F.log(F.lit(2.0))).alias("bits_per_base"))


@query("a28_cross_tab", "select l_returnflag as context, count(case when l_linestatus = 'F' then 1 end) as f, count(case when l_linestatus = 'O' then 1 end) as o from lineitem group by 1")
def a28(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("context")).pivot("l_linestatus", ["F", "O"]).count().fillna(0)
    return t.withColumnsRenamed({"F": "f", "O": "o"})


@query("a30_regression_summary", f"with {METRIC} select grp, round(regr_slope(t, p), 6) as beta, round(avg(case when sign(t) = sign(p) then 1.0 else 0.0 end), 6) as concordance, round(var_pop(p) / nullif(var_pop(t), 0), 6) as variance_ratio, round(quantile_cont(abs(t), 0.95), 6) as p95 from m where t is not null group by 1")
def a30(spark, d):
    m = table(spark, d, "lineitem").where("l_partkey % 11 <> 0").select(F.col("l_linenumber").alias("grp"), (F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_quantity") * 1.5).alias("p"))
    return m.groupBy("grp").agg(
        r6(F.regr_slope("t", "p")).alias("beta"), r6(F.avg(F.when(F.signum("t") == F.signum("p"), 1.0).otherwise(0.0))).alias("concordance"),
        r6(F.var_pop("p") / F.nullif(F.var_pop("t"), F.lit(0.0))).alias("variance_ratio"), r6(F.percentile(F.abs("t"), F.lit(0.95))).alias("p95"),
    )


@query("a33_classification", "with c as (select sum(case when quality = 1 and toxic = 1 then 1 else 0 end) as tp, sum(case when quality = 0 and toxic = 0 then 1 else 0 end) as tn, sum(case when quality = 0 and toxic = 1 then 1 else 0 end) as fp, sum(case when quality = 1 and toxic = 0 then 1 else 0 end) as fn from labels) select tp::bigint as tp, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) as accuracy, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c")
def a33(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    c = table(spark, d, "labels").agg(*[F.sum(F.when((q == a) & (t == b), 1).otherwise(0)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))])
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return c.select("*", r6((F.col("tp") + F.col("tn")) / total).alias("accuracy"), r6(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


@query("a34_dedup_ceiling", f"with {PHENO}, v as (select trait, grp, value, avg(value) over (partition by trait) as m, avg(value) over (partition by trait, grp) as g from pheno where value is not null) select trait, round(1 - sum((value - g) * (value - g)) / nullif(sum((value - m) * (value - m)), 0), 6) as ceiling from v group by 1")
def a34(spark, d):
    # within and between sums of squares, from one row a group
    g = pheno(spark, d).where("value is not null").groupBy("trait", "grp").agg(one().alias("n"), F.avg("value").alias("g"), F.var_pop("value").alias("v"))
    t = g.groupBy("trait").agg((F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("m"))
    within, between = F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.pow(F.col("g") - F.col("m"), 2))
    return g.join(t, "trait").groupBy("trait").agg(r6(1 - within / F.nullif(within + between, F.lit(0.0))).alias("ceiling"))


@query("w14_ordinal_ranks", f"with {PHENO} select iid, row_number() over (partition by trait order by value, iid) as ordinal from pheno where value is not null")
def w14(spark, d):
    return row_numbers(pheno(spark, d).where("value is not null"), ["trait"], ["value", "iid"], "ordinal").select("iid", "ordinal")


@query("w15_average_ranks", "select l_orderkey, l_linenumber, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as rank from lineitem")
def w15(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return average_ranks(items, "l_quantity", ["l_suppkey"]).select("l_orderkey", "l_linenumber", "rank")


@query("w16_zscore", f"with {PHENO} select iid, round(case when count(value) over (partition by trait) >= 2 then (value - avg(value) over (partition by trait)) / coalesce(nullif(stddev_pop(value) over (partition by trait), 0), 1) end, 6) as z from pheno")
def w16(spark, d):
    return with_zscore(pheno(spark, d), "value", ["trait"]).select("iid", r6(F.col("z")).alias("z"))


@query("w17_train_zscore", f"with {PHENO}, s as (select trait, avg(value) as m, stddev_samp(value) as sd from pheno where iid % 3 <> 0 group by 1) select iid, round(case when sd > 0.001 then (value - m) / sd end, 6) as z from pheno left join s using (trait)")
def w17(spark, d):
    return with_train_zscore(pheno(spark, d), "value", F.col("iid") % 3 != 0, ["trait"]).select("iid", r6(F.col("z")).alias("z"))


@query("w7_density", "with s as (select distinct l_linenumber as chrom, l_partkey as pos from lineitem) select chrom, pos, count(*) over (partition by chrom order by pos range between 100 preceding and 100 following) as near from s")
def w7(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("chrom"), F.col("l_partkey").alias("pos")).distinct()
    return near_counts(s, 100)


@query("w5_upstream_markov", "with c as (select conv_id, turn, length(text) % 2 as allele, lag(length(text) % 2) over (partition by conv_id order by turn) as prev from conversations) select turn, prev, count(*) as n, round((sum(allele) + 0.5) / (count(*) + 1.0), 6) as p from c where prev is not null group by 1, 2")
def w5(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 2).alias("allele"))
    c = c.withColumn("prev", F.lag("allele").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return c.groupBy("turn", "prev").agg(one().alias("n"), r6((F.sum("allele") + 0.5) / (one() + 1.0)).alias("p"))


@query("w20_quintile_strata", f"with {PHENO}, q as (select trait, quantile_cont(value, 0.2) as a, quantile_cont(value, 0.4) as b, quantile_cont(value, 0.6) as c, quantile_cont(value, 0.8) as d from pheno where value is not null group by 1) select trait, case when value >= d then 4 when value >= c then 3 when value >= b then 2 when value >= a then 1 else 0 end as stratum, count(*) as n from pheno join q using (trait) where value is not null group by 1, 2")
def w20(spark, d):
    p = pheno(spark, d).where("value is not null")
    q = p.groupBy("trait").agg(F.percentile("value", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    return p.join(q, "trait").groupBy("trait", F.size(F.filter("q", lambda x: x <= F.col("value"))).alias("stratum")).agg(one().alias("n"))
