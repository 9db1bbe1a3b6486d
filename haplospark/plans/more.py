"""Further filters, joins, pooled metrics, ordered operators, draws and scalars of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions import seq
from haplospark.operators.dealing import parts
from haplospark.operators.interval import point_in_interval
from haplospark.operators.ranking import row_numbers
from haplospark.operators.stored import stored
from haplospark.plans.base import ALLC, DOSAGE, PHENO, SITES, allc, dosage, pheno, sites
from haplospark.plans.joins import HAPS, _haplotypes
from haplospark.plans.registry import query, table
from haplospark.plans.variants import PAIRS, VAR, one, pairs, r6, variants

#: (vec_id, label, dim from 1, x): the embeddings, one row a component.
LONG = "long as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings)"


def components(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    return e.withColumn("x", F.col("x").cast("double"))


def drawn(text, n):
    """A number from 1 to n drawn by the md5 of a text; equal on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n + 1


@query("p2_reference_base", f"with {SITES}, {VAR} select v.chrom, count(*) as n, count(*) filter (where substr('ACGT', cast((s.chrom + s.pos) % 4 as integer) + 1, 1) <> v.ref) as dropped from var v join sites s on s.chrom = v.chrom and s.pos = v.pos group by 1")
def p2(spark, d):
    base = sites(spark, d).selectExpr("chrom", "pos", "substr('ACGT', cast((chrom + pos) % 4 as integer) + 1, 1) as base")
    return variants(spark, d).join(base, ["chrom", "pos"]).groupBy("chrom").agg(one().alias("n"), F.count_if(F.col("base") != F.col("ref")).alias("dropped"))


@query("p5_numeric_chroms", "with c as (select p_partkey as id, regexp_replace(upper(case when p_size < 10 then 'ChrM' when p_size < 20 then 'scaffold_1' else 'chr' || p_size end), '^CHR', '') as name from part) select id, try_cast(name as integer) as chrom from c where regexp_matches(name, '^[0-9]+$')")
def p5(spark, d):
    size = F.col("p_size")
    name = F.when(size < 10, "ChrM").when(size < 20, "scaffold_1").otherwise(F.concat(F.lit("chr"), size.cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), seq.chrom_number(name).alias("chrom")).where("chrom is not null")


@query("p8_unknown_base_reject", "with k as (select p_partkey, upper(translate(substr(md5(cast(p_partkey as varchar)), 1, 6), '0123456789abcdef', 'acgtacgtacgtacgn')) as kmer from part) select p_partkey, kmer from k where not contains(kmer, 'N')")
def p8(spark, d):
    digest = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)
    kmer = F.upper(F.translate(digest, "0123456789abcdef", "acgtacgtacgtacgn"))
    return table(spark, d, "part").select("p_partkey", kmer.alias("kmer")).where(~F.contains("kmer", F.lit("N")))


@query("p12_degenerate_targets", f"with {PAIRS} select gene, count(*) filter (where line % 4 <> 0) as n_train, count(*) filter (where line % 4 = 0) as n_val from pairs group by 1 having count(*) filter (where line % 4 <> 0) >= 10 and count(*) filter (where line % 4 = 0) >= 2 and var_pop(y) >= 0.0001")
def p12(spark, d):
    held = F.col("line") % 4 == 0
    g = pairs(spark, d).groupBy("gene").agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_val"), F.var_pop("y").alias("v"))
    return g.where("n_train >= 10 and n_val >= 2 and v >= 0.0001").drop("v")


@query("p15_rare_alleles", f"with {DOSAGE} select variant, count(*) as ac from dosage group by 1 having count(*) <= 25")
def p15(spark, d):
    return dosage(spark, d).groupBy("variant").agg(one().alias("ac")).where("ac <= 25")


@query("p17_changed_base", f"with {VAR} select id, ref || '>' || alt as label, ref || alt in ('AG', 'GA', 'CT', 'TC') as transition from var where alt <> ref")
def p17(spark, d):
    pair = F.concat("ref", "alt")
    return variants(spark, d).where("alt <> ref").select("id", F.concat_ws(">", "ref", "alt").alias("label"), pair.isin("AG", "GA", "CT", "TC").alias("transition"))


@query("j4_cis_half_open", f"with {SITES}, {VAR} select v.id, count(*) as n from var v join sites s on s.chrom = v.chrom and s.pos >= v.pos - 20 and s.pos < v.pos + 20 group by 1")
def j4(spark, d):
    v = variants(spark, d).select("id", "chrom", (F.col("pos") - 20).alias("lo"), (F.col("pos") + 20).alias("hi"))
    return point_in_interval(sites(spark, d), v, ["chrom"], "pos", "lo", "hi", "left", 64).groupBy("id").agg(one().alias("n"))


@query("j8_one_based_window", f"with {SITES}, {VAR} select v.id, s.pos - v.pos - 1 as at from var v join sites s on s.chrom = v.chrom and s.pos >= v.pos + 1 and s.pos < v.pos + 31")
def j8(spark, d):
    v = variants(spark, d).select("id", "chrom", (F.col("pos") + 1).alias("lo"), (F.col("pos") + 31).alias("hi"))
    return point_in_interval(sites(spark, d), v, ["chrom"], "pos", "lo", "hi", "left", 64).select("id", (F.col("pos") - F.col("lo")).alias("at"))


@query("j11_site_info", "select l_orderkey, l_linenumber, p_size as info from lineitem left join (select p_partkey, p_size from part where p_size < 25) on l_partkey = p_partkey")
def j11(spark, d):
    info = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("info"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(info, "l_partkey", "left").drop("l_partkey")


@query("j14_site_membership", f"with {ALLC} select accession, chrom, site, cast(mc as bigint) as mc, cast(total as bigint) as total from allc where site in (select p_partkey from part where p_size > 25)")
def j14(spark, d):
    kept = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("site"))
    return allc(spark, d).join(kept, "site", "left_semi").select("accession", "chrom", "site", "mc", "total")


@query("j20_reference_haplotype", f"with {HAPS}, u as (select window_id, alts, count(*) as m from fp group by 1, 2) select a.window_id, a.alts, coalesce(r.m, a.m) as ref_multiplicity from u a left join u r on r.window_id = a.window_id and r.alts = ''")
def j20(spark, d):
    u = _haplotypes(spark, d).select("window_id", "alts", "multiplicity")
    ref = u.where("alts = ''").select("window_id", F.col("multiplicity").alias("m"))
    return u.join(ref, "window_id", "left").select("window_id", "alts", F.coalesce("m", "multiplicity").alias("ref_multiplicity"))


@query("j23_alias_names", "with n as (select p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as name from part) select p_partkey, case name when 'BRAND11' then 'B73' when 'BRAND12' then 'MO17' else name end as line from n")
def j23(spark, d):
    name = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    alias = F.create_map(*map(F.lit, ("BRAND11", "B73", "BRAND12", "MO17")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(alias, name), name).alias("line"))


@query("j26_outer_merge", f"with {PHENO}, a as (select grp, max(value) as base from pheno where trait = 'BUILDING' group by 1), b as (select grp, max(value) as head from pheno where trait = 'MACHINERY' group by 1) select grp, base, head, round(head - base, 4) as gain from a full join b using (grp)")
def j26(spark, d):
    best = lambda trait, name: pheno(spark, d).where(F.col("trait") == trait).groupBy("grp").agg(F.max("value").alias(name))
    return best("BUILDING", "base").join(best("MACHINERY", "head"), "grp", "full").withColumn("gain", F.round(F.col("head") - F.col("base"), 4))


@query("j27_kinship_cutoff", "with k as (select l_suppkey as i, l_partkey as j, l_discount as k from lineitem) select i from k group by 1 having coalesce(max(case when j < 20 then k end), 0) < 0.095")
def j27(spark, d):
    held = F.max(F.when(F.col("l_partkey") < 20, F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i")).agg(F.coalesce(held, F.lit(0)).alias("k")).where("k < 0.095").select("i")


@query("a17_embedding_variance", f"with {LONG}, v as (select label, dim, greatest(avg(x * x) - avg(x) * avg(x), 0) as v from long group by 1, 2) select label, round(sum(v), 5) as variance from v group by 1")
def a17(spark, d):
    v = F.greatest(F.avg(F.col("x") * F.col("x")) - F.pow(F.avg("x"), 2), F.lit(0.0))
    return components(spark, d).groupBy("label", "dim").agg(v.alias("v")).groupBy("label").agg(F.round(F.sum("v"), 5).alias("variance"))


@query("a18_pooled_embeddings", f"with {LONG} select label, cast(dim as integer) as dim, round(sum(x), 4) as total, round(avg(x), 5) as mean from long group by 1, 2")
def a18(spark, d):
    return components(spark, d).groupBy("label", (F.col("dim") + 1).alias("dim")).agg(F.round(F.sum("x"), 4).alias("total"), F.round(F.avg("x"), 5).alias("mean"))


@query("a23_controls", f"with {DOSAGE}, c as (select sample, count(*) over (partition by variant) as ac from dosage), s as (select sample, count(*) filter (where ac <= 25) as n from c group by 1), m as (select quantile_cont(n, 0.5) as med from s where n > 0) select sample, n, n < med * 0.9 as control from s, m")
def a23(spark, d):
    c = dosage(spark, d).withColumn("ac", one().over(W.partitionBy("variant")))
    s = c.groupBy("sample").agg(F.count_if(F.col("ac") <= 25).alias("n"))
    middle = s.where("n > 0").agg(F.percentile("n", F.lit(0.5)).alias("med"))  # one row
    return s.join(F.broadcast(middle)).select("sample", "n", (F.col("n") < F.col("med") * 0.9).alias("control"))


@query("a32_bootstrap", f"with {PAIRS}, g as (select line, count(*) as n, sum(y) as s from pairs group by 1), l as (select *, row_number() over (order by line) as no from g), k as (select count(*) as m from l), d as (select distinct b, ('0x' || substr(md5(concat(b, '-', l.no - 1)), 1, 8))::bigint % m + 1 as no from k, range(0, 200) t(b), l), e as (select b, sum(s) / sum(n) as mean from d join l using (no) group by 1) select round(quantile_cont(mean, 0.025), 5) as low, round(quantile_cont(mean, 0.975), 5) as high, count(*) as resamples from e")
def a32(spark, d):
    """95 % interval of a mean over 200 resamples of the lines; a line counts once in a resample, however often drawn."""
    lines = pairs(spark, d).groupBy("line").agg(one().alias("n"), F.sum("y").alias("s"))
    lines = stored(row_numbers(lines, [], [F.col("line").isNull(), "line"], "no", "m"))  # a null is the last line, as in SQL
    n = parts(lines, weight=200)
    draws = lines.select("m", (F.col("no") - 1).alias("i")).repartition(n, "i").select("*", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    picked = draws.select("b", drawn(F.concat_ws("-", F.col("b").cast("string"), F.col("i").cast("string")), F.col("m")).alias("no")).repartition(n, "no").distinct()
    mean = picked.join(lines, "no").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("mean"))
    at = lambda q: F.round(F.percentile("mean", F.lit(q)), 5)
    return mean.agg(at(0.025).alias("low"), at(0.975).alias("high"), one().alias("resamples"))


@query("a44_alt_fraction", f"with {DOSAGE}, n as (select count(distinct variant) as n from dosage) select sample, round(count(*) * 1.0 / max(n), 6) as fraction from dosage, n group by 1")
def a44(spark, d):
    calls = dosage(spark, d)
    total = calls.agg(F.count_distinct("variant").alias("n"))  # one row
    return calls.groupBy("sample").agg(one().alias("k")).join(F.broadcast(total)).select("sample", r6(F.col("k") / F.col("n")).alias("fraction"))


@query("a48_within_group_spread", f"with {PHENO}, g as (select trait, grp, stddev_pop(value) as sd from pheno where value is not null group by 1, 2 having count(*) > 1) select trait, count(*) as groups, round(avg(sd), 4) as spread from g group by 1")
def a48(spark, d):
    g = pheno(spark, d).where("value is not null").groupBy("trait", "grp").agg(F.stddev_pop("value").alias("sd"), one().alias("n")).where("n > 1")
    return g.groupBy("trait").agg(one().alias("groups"), F.round(F.avg("sd"), 4).alias("spread"))


@query("a49_pooled_metrics", f"with {PAIRS} select count(*) as n, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(case when var_pop(p) > 0 then corr(y, p) else 0 end, 6) as pearson from pairs")
def a49(spark, d):
    gap = F.col("y") - F.col("p")
    r2 = 1 - F.sum(gap * gap) / F.nullif(F.var_pop("y") * one(), F.lit(0.0))
    return pairs(spark, d).agg(one().alias("n"), r6(r2).alias("r2"), r6(F.when(F.var_pop("p") > 0, F.corr("y", "p")).otherwise(0.0)).alias("pearson"))


@query("a51_centroid_distance", f"with {LONG}, c as (select label, dim, avg(x) as m from long group by 1, 2), t as (select label, vec_id, sqrt(sum((x - m) * (x - m))) as l2 from long join c using (label, dim) group by 1, 2) select label, count(*) as n, round(avg(l2), 4) as mean, round(max(l2), 4) as most from t group by 1")
def a51(spark, d):
    e = components(spark, d)
    centre = e.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    l2 = e.join(centre, ["label", "dim"]).groupBy("label", "vec_id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("l2"))
    return l2.groupBy("label").agg(one().alias("n"), F.round(F.avg("l2"), 4).alias("mean"), F.round(F.max("l2"), 4).alias("most"))


@query("a53_model_table", f"with {PAIRS} select line, 'base' as model, count(*) as n, round(avg((y - p) * (y - p)), 4) as mse, round(corr(y, p), 6) as pearson from pairs group by 1 union all select line, 'shifted', count(*), round(avg((y - 2 * p) * (y - 2 * p)), 4), round(corr(y, 2 * p), 6) from pairs group by 1")
def a53(spark, d):
    """Both models in one pass: each pair is scored under every model."""
    models = F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("p").alias("q")), F.struct(F.lit("shifted").alias("model"), (2 * F.col("p")).alias("q"))))
    scored = pairs(spark, d).select("line", "y", models.alias("m")).select("line", "y", "m.*")
    return scored.groupBy("line", "model").agg(one().alias("n"), F.round(F.avg(F.pow(F.col("y") - F.col("q"), 2)), 4).alias("mse"), r6(F.corr("y", "q")).alias("pearson"))


@query("w4_sliding_alts", "with c as (select distinct l_suppkey as sample, l_partkey as pos from lineitem where l_returnflag = 'R'), l as (select array_to_string(list(pos) over (partition by sample order by pos range between 20 preceding and 20 following), ',') as alts from c) select distinct alts from l")
def w4(spark, d):
    c = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("pos")).distinct()
    near = F.collect_list("pos").over(W.partitionBy("sample").orderBy("pos").rangeBetween(-20, 20))
    return c.select(F.array_join(near, ",").alias("alts")).distinct()


@query("w6_has_upstream", "select conv_id, turn, dense_rank() over (partition by conv_id order by turn) > 1 as has_upstream from conversations")
def w6(spark, d):
    first = F.dense_rank().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", (first > 1).alias("has_upstream"))


@query("w18_quartile_bins", f"with {PHENO}, q as (select trait, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from pheno where value is not null group by 1) select trait, case when value > c then 3 when value > b then 2 when value > a then 1 else 0 end as bin, count(*) as n, round(avg(value), 4) as mean from pheno join q using (trait) where value is not null group by 1, 2")
def w18(spark, d):
    p = pheno(spark, d).where("value is not null")
    q = p.groupBy("trait").agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    bin_no = F.size(F.filter("q", lambda x: x < F.col("value")))
    return p.join(q, "trait").groupBy("trait", bin_no.alias("bin")).agg(one().alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("w22_window_features", f"with {SITES} select chrom, pos, cast((pos - 25 + pos + 26) // 2 as bigint) as centre, round(sin(pos / 100.0), 6) as s, round(cos(pos / 100.0), 6) as c from sites")
def w22(spark, d):
    return sites(spark, d).select("chrom", "pos", F.expr("(pos - 25 + pos + 26) div 2").alias("centre"), r6(F.sin(F.col("pos") / 100.0)).alias("s"), r6(F.cos(F.col("pos") / 100.0)).alias("c"))


@query("o8_background_pairs", "with f as (select distinct l_partkey as gene, l_suppkey as line from lineitem where l_returnflag = 'R'), k as (select max(gene) as g, max(line) as l from f), d as (select distinct ('0x' || substr(md5(concat(gene, '-', line, '-g')), 1, 8))::bigint % g + 1 as gene, ('0x' || substr(md5(concat(gene, '-', line, '-l')), 1, 8))::bigint % l + 1 as line from f, k) select gene, line from d where not exists (select 1 from f where f.gene = d.gene and f.line = d.line)")
def o8(spark, d):
    """One draw with replacement for each focus pair, made where the pair is; focus pairs and repeats go."""
    f = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("line")).distinct()
    most = f.agg(F.max("gene").alias("g"), F.max("line").alias("l"))  # one row
    key = lambda tag: F.concat_ws("-", F.col("gene").cast("string"), F.col("line").cast("string"), F.lit(tag))
    draws = f.join(F.broadcast(most)).select(drawn(key("g"), F.col("g")).alias("gene"), drawn(key("l"), F.col("l")).alias("line")).distinct()
    return draws.join(f, ["gene", "line"], "left_anti")


@query("o9_leaderboard", "select p_brand, max(p_retailprice) as best, count(*) as runs from part group by 1 order by best desc, p_brand")
def o9(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("best"), one().alias("runs")).orderBy(F.desc("best"), "p_brand")


@query("o11_even_positions", "select doc_id, i, cast(round_even(i * (length(text) - 1) / 4.0, 0) as bigint) as at from documents, range(0, 5) t(i) where length(text) >= 5")
def o11(spark, d):
    docs = table(spark, d, "documents").where("length(text) >= 5").select("doc_id", F.length("text").alias("n"))
    spread = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("i"))
    return spread.select("doc_id", "i", F.bround(F.col("i") * (F.col("n") - 1) / 4.0).cast("long").alias("at"))


@query("u1_union_all", "select l_orderkey as id, 'focus' as part from lineitem where l_returnflag = 'R' union all select o_orderkey, 'background' from orders where o_orderstatus = 'O'")
def u1(spark, d):
    focus = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit("focus").alias("part"))
    rest = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.lit("background").alias("part"))
    return focus.unionByName(rest)


@query("u4_distinct", "select distinct l_partkey as gene, l_suppkey as line from lineitem")
def u4(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("line")).distinct()


@query("u5_position_union", "select l_partkey, string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) as positions from lineitem group by 1")
def u5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("positions"))


@query("f5_tokenised_windows", "with s as (select p_partkey, upper(translate(substr(md5(cast(p_partkey as varchar)), 1, 20), '0123456789abcdef', 'acgtacgtacgtacgt')) as s from part) select p_partkey, concat_ws(' ', substr(s, 1, 6), substr(s, 7, 6), substr(s, 13, 6), rpad(substr(s, 19, 6), 6, 'A')) as tokens from s")
def f5(spark, d):
    s = F.upper(F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 20), "0123456789abcdef", "acgtacgtacgtacgt"))
    tokens = F.transform(F.sequence(F.lit(1), F.lit(20), F.lit(6)), lambda i: F.rpad(F.substring(s, i, F.lit(6)), 6, "A"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@query("f9_allele_combinations", "select p_partkey, combo, cast(bit_count(combo) as integer) as alts from (select p_partkey, unnest(range(0, cast(pow(2, p_size % 4) as bigint))) as combo from part)")
def f9(spark, d):
    most = F.pow(F.lit(2), F.col("p_size") % 4).cast("long") - 1
    c = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("combo"))
    return c.withColumn("alts", F.bit_count("combo").cast("int"))


@query("f12_tss_distance", f"with {VAR}, g as (select id, pos, ref in ('A', 'C') as plus from var) select id, case when plus then pos else pos + 50 end as tss, case when plus then pos + 50 else pos end as tts from g")
def f12(spark, d):
    plus = F.col("ref").isin("A", "C")
    start, end = F.col("pos"), F.col("pos") + 50
    return variants(spark, d).select("id", F.when(plus, start).otherwise(end).alias("tss"), F.when(plus, end).otherwise(start).alias("tts"))


@query("f27_f28_level_weight", f"with {ALLC} select accession, chrom, site, round(case when total >= 5 then mc * 1.0 / greatest(total, 1) end, 6) as level, round(least(total, 20) / 20.0, 6) as weight from allc")
def f27(spark, d):
    total = F.col("total")
    level = F.when(total >= 5, F.col("mc") / F.greatest(total, F.lit(1)))
    return allc(spark, d).select("accession", "chrom", "site", r6(level).alias("level"), r6(F.least(total, F.lit(20)) / 20.0).alias("weight"))
