"""Remaining filters, keyed joins, ordered samples, views and scalar expressions of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions import seq
from haplospark.operators.choose import matching, resolve
from haplospark.operators.interval import point_in_interval
from haplospark.operators.ranking import row_numbers
from haplospark.operators.sampling import draw_key
from haplospark.plans.base import ALLC, DOSAGE, PHENO, SITES, allc, dosage, pheno, sites
from haplospark.plans.joins import HAPS, _haplotypes
from haplospark.plans.more import LONG, components
from haplospark.plans.registry import query, table
from haplospark.plans.variants import PAIRS, VAR, one, pairs, r6, variants

#: A sequence of 32 bases for each part, in SQL of either engine.
_SEQ = "upper(translate(md5(cast(p_partkey as {0})), '0123456789abcdef', 'acgtacgtacgtacgt'))"
_HALF = "upper(translate(substr(md5(cast(p_partkey {1} as {0})), 1, 6), '0123456789abcdef', '{2}'))"


def near_sites(spark, d):
    """(id, pos, lo) of the sites within 20 bases of each variant."""
    v = variants(spark, d).select("id", "chrom", (F.col("pos") - 20).alias("lo"), (F.col("pos") + 20).alias("hi"))
    return point_in_interval(sites(spark, d), v, ["chrom"], "pos", "lo", "hi", "left", 64).select("id", "pos", "lo")


_NEAR = f"{SITES}, {VAR}, near as (select v.id, s.pos, v.pos - 20 as lo from var v join sites s on s.chrom = v.chrom and s.pos >= v.pos - 20 and s.pos < v.pos + 20)"


@query("p6_site_selection", f"with {ALLC}, g as (select chrom, site, count(*) as n, avg(mc * 1.0 / greatest(total, 1)) as level, min(context) as context from allc where total >= 5 group by 1, 2) select chrom, site, n, round(level, 6) as level from g where context in ('A', 'N') and level > 0.1 and level < 0.9 order by md5(concat(chrom, ':', site, '-7')), chrom, site limit 200")
def p6(spark, d):
    """Sites by coverage, context and level, then a drawn sample of 200."""
    level = F.avg(F.col("mc") / F.greatest("total", F.lit(1)))
    g = allc(spark, d, ("site",)).where("total >= 5").groupBy("chrom", "site").agg(one().alias("n"), level.alias("level"), F.min("context").alias("context"))
    kept = g.where(F.col("context").isin("A", "N") & (F.col("level") > 0.1) & (F.col("level") < 0.9))
    key = F.md5(F.concat(F.col("chrom").cast("string"), F.lit(":"), F.col("site").cast("string"), F.lit("-7")))
    return kept.orderBy(key, "chrom", "site").limit(200).select("chrom", "site", "n", r6("level").alias("level"))


@query("p7_variant_windows", f"with {HAPS} select window_id, alts, count(*) as multiplicity from fp where alts <> '' group by 1, 2")
def p7(spark, d):
    return _haplotypes(spark, d).where("alts <> ''").select("window_id", "alts", "multiplicity")


@query("p9_mapping_quality", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 30 and 1 - l_discount >= 0.95 and l_returnflag <> 'N'")
def p9(spark, d):
    good = (F.col("l_quantity") >= 30) & (1 - F.col("l_discount") >= 0.95) & (F.col("l_returnflag") != "N")
    return table(spark, d, "lineitem").where(good).select("l_orderkey", "l_linenumber")


@query("p13_registry_filter", "select p_partkey, p_brand, p_size from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#13') and p_size in (10)")
def p13(spark, d):
    return matching(table(spark, d, "part"), p_brand=["Brand#11", "Brand#12", "Brand#13"], p_size=10, p_type=None).select("p_partkey", "p_brand", "p_size")


@query("p14_trait_resolution", "select l_suppkey as iid, round(avg(l_quantity), 5) as l_quantity, round(avg(l_tax), 5) as l_tax from lineitem group by 1")
def p14(spark, d):
    rows = table(spark, d, "lineitem")
    traits = resolve(rows, ["l_quantity", "l_tax"], ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return rows.groupBy(F.col("l_suppkey").alias("iid")).agg(*[F.round(F.avg(t), 5).alias(t) for t in traits])


@query("j19_scatter", f"with {PAIRS}, ids as (select distinct gene, line from pairs), pred as (select gene, line, round(avg(p), 5) as p from pairs where l_orderkey % 3 <> 0 group by 1, 2) select gene, line, p from ids left join pred using (gene, line)")
def j19(spark, d):
    """Predictions laid into the cells of the data set; one aggregation makes both sides, so nothing is joined."""
    known = F.when(F.col("l_orderkey") % 3 != 0, F.col("p"))
    return pairs(spark, d).groupBy("gene", "line").agg(F.round(F.avg(known), 5).alias("p"))


@query("j28_reference_key", f"with {HAPS}, k as (select window_id, alts from fp union select distinct window_id, '' from fp) select window_id, alts, row_number() over (partition by window_id order by alts) - 1 as idx from k")
def j28(spark, d):
    """Each window's keys with the reference's added where it is missing, numbered from 0 within the window."""
    u = _haplotypes(spark, d).select("window_id", "alts")
    keys = u.unionByName(u.select("window_id", F.lit("").alias("alts"))).distinct()
    return keys.withColumn("idx", F.row_number().over(W.partitionBy("window_id").orderBy("alts")) - 1)


@query("w3_buffered_bounds", f"with {SITES} select chrom, pos, greatest(0, pos - 25) as start, pos + 26 as stop from sites")
def w3(spark, d):
    return sites(spark, d).select("chrom", "pos", F.greatest(F.lit(0), F.col("pos") - 25).alias("start"), (F.col("pos") + 26).alias("stop"))


_EDGES = ", ".join(str(i / 10) for i in range(11))
_BIN = " + ".join(f"(p >= e[{i}])::int" for i in range(2, 11))


@query("w19_calibration", f"with {PAIRS}, q as (select quantile_cont(p, [{_EDGES}]) as e from pairs), b as (select {_BIN} as bin, p, y, p >= e[1] and p < e[11] + 1e-9 as inside from pairs, q) select bin, count(*) as n, round(avg(p), 4) as mean_p, round(avg(y), 4) as mean_y from b where inside group by 1 having count(*) >= 5")
def w19(spark, d):
    """Mean truth and prediction of each tenth of the predictions, [lo, hi); tenths of fewer than five points go."""
    rows = pairs(spark, d)
    edges = rows.agg(F.percentile("p", F.array(*[F.lit(i / 10) for i in range(11)])).alias("e"))  # one row
    inner = F.slice("e", 2, 9)
    b = rows.join(F.broadcast(edges)).select("p", "y", F.size(F.filter(inner, lambda x: x <= F.col("p"))).alias("bin"))
    return b.groupBy("bin").agg(one().alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("y"), 4).alias("mean_y")).where("n >= 5")


@query("o5_reservoir", f"with {VAR} select id, chrom, pos from var where alt in ('A', 'C', 'G', 'T') and alt <> ref order by md5(concat(id, '-11')), id limit 100")
def o5(spark, d):
    """A sample of 100 eligible variants in drawn order: what a reservoir over the stream would be, but the same on every layout."""
    v = variants(spark, d).where(F.col("alt").isin(list("ACGT")) & (F.col("alt") != F.col("ref")))
    return v.orderBy(draw_key("id", 11), "id").limit(100).select("id", "chrom", "pos")


@query("o10_stride", f"with {SITES}, r as (select *, row_number() over (partition by chrom order by pos) - 1 as ord from sites) select chrom, pos from r where ord % 7 = 0")
def o10(spark, d):
    """Every seventh site of each chromosome."""
    return row_numbers(sites(spark, d), ["chrom"], ["pos"]).where("(rn - 1) % 7 = 0").select("chrom", "pos")


@query("r6_views", f"with {PHENO}, v as (select 'coverage' as view, trait as key, count(value) as n, round(avg(value), 4) as mean from pheno group by 2 union all select 'group', cast(grp as varchar), count(value), round(avg(value), 4) from pheno group by 2) select * from v")
def r6_views(spark, d):
    """Several views of one long table from a single pass over it."""
    keys = F.array(F.struct(F.lit("coverage").alias("view"), F.col("trait").alias("key")), F.struct(F.lit("group").alias("view"), F.col("grp").cast("string").alias("key")))
    rows = pheno(spark, d).select("value", F.explode(keys).alias("k")).select("value", "k.*")
    return rows.groupBy("view", "key").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("f1_patched_window", f"with s as (select p_partkey, {_SEQ.format('varchar')} as s, cast(p_size as integer) % 40 - 10 as start, cast(p_partkey % 32 as integer) as spot from part), t as (select *, substr(s, 1, spot) || 'T' || substr(s, spot + 2) as t from s) select p_partkey, rpad(repeat('N', greatest(0, -start)) || substr(t, greatest(start, 0) + 1, greatest(0, start + 20 - greatest(start, 0))), 20, 'N') as bases from t")
def f1(spark, d):
    """A window of 20 bases over the patched sequence, clipped to it and padded with N on either side."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_SEQ.format('string')} as s", "p_size % 40 - 10 as start", "cast(p_partkey % 32 as int) as at")
    alts = F.array(F.struct(F.col("at"), F.lit("T").alias("base")))
    return rows.select("p_partkey", seq.window(seq.patch(F.col("s"), alts), F.col("start"), 20).alias("bases"))


@query("f7_token_index", f"with {_NEAR} select id, pos, 1 + (pos - lo) // 6 as token from near")
def f7(spark, d):
    return near_sites(spark, d).select("id", "pos", F.expr("1 + (pos - lo) div 6").alias("token"))


@query("f8_token_mask", f"with {_NEAR}, m as (select id, t, max(case when (pos - lo) // 6 = t then '1' else '0' end) as bit from near, range(0, 7) u(t) group by 1, 2) select id, string_agg(bit, '' order by t) as mask from m group by 1")
def f8(spark, d):
    """One flag for each six-base token of the window: whether a site stands in it."""
    hit = near_sites(spark, d).groupBy("id").agg(F.collect_set(F.expr("(pos - lo) div 6")).alias("hit"))
    mask = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")), lambda t: F.array_contains("hit", t).cast("int").cast("string"))
    return hit.select("id", F.array_join(mask, "").alias("mask"))


@query("f11_strand_index", f"with {SITES}, l as (select chrom, max(pos) + 1 as len from sites group by 1), o as (select chrom, coalesce(sum(len) over (order by chrom rows between unbounded preceding and 1 preceding), 0) as off from l) select chrom, pos, pos % 2 as strand, cast(2 * (off + pos) + pos % 2 as bigint) as idx from sites join o using (chrom)")
def f11(spark, d):
    """A number for each strand of each base over all chromosomes; what comes back is read out of that number."""
    s = sites(spark, d)
    lengths = s.groupBy("chrom").agg((F.max("pos") + 1).alias("len"))  # a row a chromosome
    known = lengths.agg(F.array_sort(F.collect_list(F.struct("chrom", "len"))).alias("c"))
    before = lambda i: F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["len"])
    starts = known.select(F.transform("c", lambda x, i: F.struct(x["chrom"].alias("chrom"), before(i).alias("off"))).alias("o"))
    at = lambda cond: F.element_at(F.filter("o", cond), -1)
    coded = s.join(F.broadcast(starts)).withColumn("idx", 2 * (at(lambda x: x["chrom"] == F.col("chrom"))["off"] + F.col("pos")) + F.col("pos") % 2)
    found = coded.withColumn("home", at(lambda x: 2 * x["off"] <= F.col("idx")))
    return found.select(F.col("home.chrom").alias("chrom"), F.expr("idx div 2 - home.off").alias("pos"), (F.col("idx") % 2).alias("strand"), "idx")


@query("f19_one_hot", f"select p_partkey, rtrim(replace(replace(replace(replace({_HALF.format('varchar', '', 'acgtacgtacgtacgn')}, 'A', 'a000 '), 'C', '0a00 '), 'G', '00a0 '), 'T', '000a ').replace('N', '0000 ').replace('a', '1')) as bits from part")
def f19(spark, d):
    bases = table(spark, d, "part").selectExpr("p_partkey", f"{_HALF.format('string', '', 'acgtacgtacgtacgn')} as s")
    rows = F.transform(seq.one_hot(F.col("s")), lambda r: F.array_join(F.transform(r, lambda b: b.cast("string")), ""))
    return bases.select("p_partkey", F.array_join(rows, " ").alias("bits"))


_SAME = " and ".join(f"(substr(a, {i}, 1) = substr(b, {i}, 1) or substr(a, {i}, 1) = 'N' or substr(b, {i}, 1) = 'N')" for i in range(1, 7))


@query("f20_equal_but_unknown", f"with s as (select p_partkey, {_HALF.format('varchar', '', 'nnnnnncacacacacc')} as a, {_HALF.format('varchar', '+ 1', 'nnnnnncacacacacc')} as b from part) select p_partkey, {_SAME} as same from s")
def f20(spark, d):
    s = table(spark, d, "part").selectExpr("p_partkey", *[f"{_HALF.format('string', plus, 'nnnnnncacacacacc')} as {k}" for k, plus in (("a", ""), ("b", "+ 1"))])
    return s.select("p_partkey", seq.same_known(F.col("a"), F.col("b")).alias("same"))


@query("f22_vector_scaling", f"with {LONG}, c as (select dim, avg(x) as m, greatest(stddev_samp(x), 1e-6) as s from long group by 1), r as (select vec_id, avg(x) as m, sqrt(var_pop(x) + 1e-5) as s from long group by 1) select l.vec_id, round(max((l.x - r.m) / r.s), 4) as layer_max, round(sum((l.x - c.m) / c.s), 3) as column_sum from long l join c using (dim) join r using (vec_id) group by 1")
def f22(spark, d):
    """Each vector scaled by its own mean and deviation, and by those of each component over all vectors."""
    e = components(spark, d)
    c = e.groupBy("dim").agg(F.avg("x").alias("m"), F.greatest(F.stddev_samp("x"), F.lit(1e-6)).alias("s"))
    scale = c.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("cs"))  # one row
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(F.broadcast(scale))
    column = F.aggregate(F.zip_with("v", "cs", lambda x, c: (x - c["m"]) / c["s"]), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.round(F.array_max(seq.layer_norm(F.col("v"))), 4).alias("layer_max"), F.round(column, 3).alias("column_sum"))


@query("f24_run_name", "with n as (select p_partkey, concat(p_brand, '/lr=', p_size, ',bs=', p_size * 2, '/v', p_partkey % 3) as run from part) select p_partkey, split_part(run, '/', 1) as model, try_cast(regexp_extract(run, 'lr=([0-9]+)', 1) as integer) as lr, try_cast(regexp_extract(run, 'bs=([0-9]+)', 1) as integer) as bs, try_cast(regexp_extract(run, '/v([0-9]+)$', 1) as integer) as version from n")
def f24(spark, d):
    run = F.concat("p_brand", F.lit("/lr="), F.col("p_size").cast("string"), F.lit(",bs="), (F.col("p_size") * 2).cast("string"), F.lit("/v"), (F.col("p_partkey") % 3).cast("string"))
    parts = F.split(run, "/")
    options = F.str_to_map(parts[1], F.lit(","), F.lit("="))
    return table(spark, d, "part").select(
        "p_partkey", parts[0].alias("model"), options["lr"].cast("int").alias("lr"), options["bs"].cast("int").alias("bs"), F.substring(parts[2], 2, 9).cast("int").alias("version")
    )


@query("f29_prior_scaling", f"with {DOSAGE}, w as (select variant, avg(dosage) / 2 as w from dosage group by 1) select sample, variant, round(dosage * sqrt(w), 6) as scaled from dosage join w using (variant)")
def f29(spark, d):
    calls = dosage(spark, d)
    weights = calls.groupBy("variant").agg((F.avg("dosage") / 2).alias("w"))
    return calls.join(weights, "variant").select("sample", "variant", r6(F.col("dosage") * F.sqrt("w")).alias("scaled"))
