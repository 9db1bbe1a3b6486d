"""Per-group linear models and shared decompositions, from moments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.functions import seq
from haplospark.operators import linear
from haplospark.plans.registry import query, table
from haplospark.plans.variants import PAIRS, one, pairs, r6

PENALTIES = (0.1, 10.0, 1000.0, 100000.0)
_LAMBDAS = ", ".join(f"({p})" for p in PENALTIES)
_SUMS = "sum(1.0::double) as n, sum(p) as x, sum(y) as y, sum(p * p) as xx, sum(p * y) as xy, sum(y * y) as yy"
_SSE = "{0}.yy - 2 * a * {0}.y - 2 * b * {0}.xy + {0}.n * a * a + 2 * a * b * {0}.x + b * b * {0}.xx"


def _cols(prefix):
    return [F.col(f"{prefix}{k}") for k in linear.SUMS]


def _fit(train, l2, l1=0.0):
    """Slope and intercept of the sums under a prefix."""
    n, x, y, xx, xy, _ = _cols(train)
    b = linear.slope(n, x, y, xx, xy, l2, l1)
    return b, (y - b * x) / n


def _rest(sums, own):
    """sums with t_*: the same sums over the window own, less the row's own."""
    return sums.select("*", *[(F.sum(k).over(own) - F.col(k)).alias(f"t_{k}") for k in linear.SUMS])


@query("m11_ridge_cv", f"""with {PAIRS}, f as (select line, l_orderkey % 5 as fold, {_SUMS} from pairs group by 1, 2),
 c as (select h.line, h.fold, l.p as penalty, h.n, h.x, h.y, h.xx, h.xy, h.yy, t.n as tn, t.x as tx, t.y as ty, t.xx as txx, t.xy as txy
   from f h join lateral (select sum(n) as n, sum(x) as x, sum(y) as y, sum(xx) as xx, sum(xy) as xy from f g where g.line = h.line and g.fold <> h.fold) t on true, (values {_LAMBDAS}) l(p) where t.n > 0),
 b as (select *, (txy - tx * ty / tn) / (txx - tx * tx / tn + penalty) as b from c), a as (select *, (ty - b * tx) / tn as a from b)
 select line, cast(penalty as double) as penalty, count(*) as folds, round(sum({_SSE.format('a')}) / sum(n), 3) as mse from a group by 1, 2""")
def m11(spark, d):
    """Held-out error of ridge for each line and penalty: a fold's training sums are the line's less its own."""
    folds = pairs(spark, d).groupBy("line", (F.col("l_orderkey") % 5).alias("fold")).agg(*linear.moment_sums("p", "y"))
    c = _rest(folds, W.partitionBy("line")).where("t_n > 0").withColumn("penalty", F.explode(F.array(*map(F.lit, PENALTIES))))
    b, a = _fit("t_", F.col("penalty"))
    c = c.withColumn("b", b).withColumn("a", a)
    sse = linear.squared_error(*_cols(""), F.col("b"), F.col("a"))
    return c.groupBy("line", "penalty").agg(one().alias("folds"), F.round(F.sum(sse) / F.sum("n"), 3).alias("mse"))


@query("m8_elastic_net", f"""with {PAIRS}, t as (select line, {_SUMS} from pairs where l_orderkey % 4 <> 0 group by 1), v as (select line, {_SUMS} from pairs where l_orderkey % 4 = 0 group by 1),
 s as (select t.*, xy - x * y / n as sxy, xx - x * x / n as sxx, l.p as penalty from t, (values {_LAMBDAS}) l(p)),
 b as (select *, sign(sxy) * greatest(abs(sxy) - penalty / 2, 0) / (sxx + penalty / 2) as b from s), a as (select *, (y - b * x) / n as a from b)
 select a.line, cast(penalty as double) as penalty, round(b, 5) + 0.0 as slope, b = 0 as dropped, round(({_SSE.format('v')}) / v.n, 3) as mse from a join v using (line) where a.n >= 30""")
def m8(spark, d):
    """Elastic net of one feature, equal parts of both penalties, with its error on the held-out orders."""
    held = F.col("l_orderkey") % 4 == 0
    sums = pairs(spark, d).groupBy("line", held.alias("held")).agg(*linear.moment_sums("p", "y"))
    train = sums.where("not held").select("line", *[F.col(k).alias(f"t_{k}") for k in linear.SUMS]).where("t_n >= 30")
    c = train.join(sums.where("held").drop("held"), "line").withColumn("penalty", F.explode(F.array(*map(F.lit, PENALTIES))))
    b, a = _fit("t_", F.col("penalty") / 2, F.col("penalty") / 2)
    c = c.withColumn("b", b).withColumn("a", a)
    mse = linear.squared_error(*_cols(""), F.col("b"), F.col("a")) / F.col("n")
    return c.select("line", "penalty", (F.round("b", 5) + 0.0).alias("slope"), (F.col("b") == 0).alias("dropped"), F.round(mse, 3).alias("mse"))


@query("m10_null_and_ridge", f"""with {PAIRS}, t as (select line, {_SUMS} from pairs where l_orderkey % 4 <> 0 group by 1), v as (select line, {_SUMS} from pairs where l_orderkey % 4 = 0 group by 1),
 b as (select *, (xy - x * y / n) / (xx - x * x / n + 1.0) as b from t), a as (select *, (y - b * x) / n as a from b)
 select a.line, cast(a.n as bigint) as n_train, cast(v.n as bigint) as n_eval, round(({_SSE.format('v')}) / v.n, 3) as ridge_mse, round((v.yy - 2 * a.y / a.n * v.y + v.n * (a.y / a.n) * (a.y / a.n)) / v.n, 3) as null_mse
 from a join v using (line) where a.n >= 30 and v.n >= 20""")
def m10(spark, d):
    """Ridge against the training mean on the held-out rows, for groups of 30 training and 20 evaluation rows at least."""
    held = F.col("l_orderkey") % 4 == 0
    sums = pairs(spark, d).groupBy("line", held.alias("held")).agg(*linear.moment_sums("p", "y"))
    train = sums.where("not held and n >= 30").select("line", *[F.col(k).alias(f"t_{k}") for k in linear.SUMS])
    c = train.join(sums.where("held and n >= 20").drop("held"), "line")
    b, a = _fit("t_", 1.0)
    c = c.withColumn("b", b).withColumn("a", a).withColumn("m", F.col("t_y") / F.col("t_n"))
    mse = lambda b, a: F.round(linear.squared_error(*_cols(""), b, a) / F.col("n"), 3)
    return c.select(
        "line", F.col("t_n").cast("long").alias("n_train"), F.col("n").cast("long").alias("n_eval"),
        mse(F.col("b"), F.col("a")).alias("ridge_mse"), mse(F.lit(0.0), F.col("m")).alias("null_mse"),
    )


@query("m14_transfer_ridge", f"""with {PAIRS}, g as (select line, {_SUMS} from pairs group by 1), s as (select sum(n) as n, sum(x) as x, sum(y) as y, sum(xx) as xx, sum(xy) as xy from g),
 o as (select g.*, s.n - g.n as tn, s.x - g.x as tx, s.y - g.y as ty, s.xx - g.xx as txx, s.xy - g.xy as txy from g, s),
 b as (select *, (txy - tx * ty / tn) / (txx - tx * tx / tn + 1.0) as b from o where tn > 0), a as (select *, (ty - b * tx) / tn as a from b)
 select line, round(b, 5) as shared_slope, round((xy - x * y / n) / (xx - x * x / n + 1.0), 5) as own_slope, round(({_SSE.format('a')}) / n, 3) as transfer_mse from a""")
def m14(spark, d):
    """Ridge of all other lines applied to a line unseen in it, beside the line's own slope."""
    g = pairs(spark, d).groupBy("line").agg(*linear.moment_sums("p", "y"))
    total = g.agg(*[F.sum(k).alias(f"s_{k}") for k in linear.SUMS])  # one row
    o = g.join(F.broadcast(total)).select("line", *linear.SUMS, *[(F.col(f"s_{k}") - F.col(k)).alias(f"t_{k}") for k in linear.SUMS]).where("t_n > 0")
    b, a = _fit("t_", 1.0)
    own, _ = _fit("", 1.0)
    o = o.withColumn("b", b).withColumn("a", a).withColumn("own", own)
    mse = linear.squared_error(*_cols(""), F.col("b"), F.col("a")) / F.col("n")
    return o.select("line", F.round("b", 5).alias("shared_slope"), F.round("own", 5).alias("own_slope"), F.round(mse, 3).alias("transfer_mse"))


@query("m7_haseman_elston", f"""with {PAIRS}, u as (select line, gene, avg(y) as y, avg(p) as p from pairs group by 1, 2),
 z as (select line, gene, y - avg(y) over (partition by line) as y, p - avg(p) over (partition by line) as z, var_pop(y) over (partition by line) as vy from u),
 q as (select a.line, a.y * b.y / a.vy as t, a.z * b.z as k from z a join z b on a.line = b.line and a.gene < b.gene where a.vy > 0)
 select line, count(*) as n_pairs, round(least(greatest(covar_pop(t, k) / var_pop(k) * 100, 0), 1), 5) as h2 from q group by 1 having var_pop(k) > 1e-9""")
def m7(spark, d):
    """Slope of trait products on kinship products over all pairs of a group, clipped to 0 to 1 (kinship in hundreds).

    The pairs are never made: sums over pairs follow from power sums, as for products
    u of each row, the sum over pairs is (sum(u)^2 - sum(u^2)) / 2.
    """
    u = pairs(spark, d).groupBy("line", "gene").agg(F.avg("y").alias("y"), F.avg("p").alias("p"))
    centre = u.groupBy("line").agg(F.avg("y").alias("my"), F.avg("p").alias("mp"), F.var_pop("y").alias("vy")).where("vy > 0")
    z = u.join(centre, "line").select("line", (F.col("y") - F.col("my")).alias("y"), (F.col("p") - F.col("mp")).alias("z"), "vy")
    over_pairs = lambda c: (F.pow(F.sum(c), 2) - F.sum(c * c)) / 2
    y, zz = F.col("y"), F.col("z")
    s = z.groupBy("line").agg(
        (one() * (one() - 1) / 2).alias("m"), over_pairs(y).alias("t"), over_pairs(zz).alias("k"),
        over_pairs(y * zz).alias("tk"), over_pairs(zz * zz).alias("kk"), F.max("vy").alias("vy"),
    ).where("m > 0")
    m = F.col("m")
    var = F.col("kk") / m - F.pow(F.col("k") / m, 2)
    cov = (F.col("tk") / m - F.col("t") / m * F.col("k") / m) / F.col("vy")
    return s.where(var > 1e-9).select("line", m.cast("long").alias("n_pairs"), F.round(F.least(F.greatest(cov / var * 100, F.lit(0.0)), F.lit(1.0)), 5).alias("h2"))


def _with_one(spark, d, *more):
    e = table(spark, d, "embeddings").where("embedding is not null")
    return e.select("vec_id", "label", F.concat(F.array(F.lit(1.0)), F.col("embedding").cast("array<double>"), *more).alias("v"))


@query("m2_ridge_grid", None)
def m2(spark, d):
    """Mean held-out Pearson of ridge from the vectors to the label, five folds by id, for each penalty."""
    rows = _with_one(spark, d, F.array(F.col("label").cast("double"))).withColumn("fold", F.pmod("vec_id", F.lit(5)))
    found = linear.ridge_grid(linear.gram(rows, "v", "fold"), [0.1, 1.0, 10.0, 100.0])
    return spark.createDataFrame([(p, r if r is None else round(r, 5)) for p, r in found], "penalty double, pearson double")


@query("m3_singular_values", None)
def m3(spark, d):
    """The ten leading singular values of the vectors of the training ids (not divisible by four)."""
    g = linear.gram(_with_one(spark, d).where("vec_id % 4 <> 0"), "v")
    values = linear.principal_axes(g[0], 10, centre=False)[2].tolist() if g else []
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(values)], "component int, value double")


@query("m12_axes_removed", None)
def m12(spark, d):
    """Length of each vector before and after its mean and three leading components are taken away."""
    rows = _with_one(spark, d)
    g = linear.gram(rows, "v")
    kept = rows.select("vec_id", F.slice("v", 2, F.size("v") - 1).alias("v"))
    if not g:
        return kept.select("vec_id", r6(seq.norm(F.col("v"))).alias("before"), F.lit(None).cast("double").alias("after")).limit(0)
    mean, axes, _ = linear.principal_axes(g[0], 3)
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    moved = kept.withColumn("c", F.zip_with("v", literal(mean), lambda a, b: a - b))
    at = F.array(*[seq.dot(F.col("c"), literal(axis)) for axis in axes])
    left = F.pow(seq.norm(F.col("c")), 2) - F.pow(seq.norm(at), 2)
    return moved.select("vec_id", r6(seq.norm(F.col("v"))).alias("before"), r6(F.sqrt(F.greatest(left, F.lit(0.0)))).alias("after"))
