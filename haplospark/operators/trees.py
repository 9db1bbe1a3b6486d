"""Regression trees, forests and boosting as aggregates: a level of all trees at once.

Features are cut into bins. No tree tells rows of a group with equal bins apart: they are
summed to a cell, and trees grow on the cells, of which there are no more than rows and
only so many as bins combine. A level sums weights and targets by (group, tree, node,
feature, bin), which merges on the map side, so no node's cells are ever gathered; the best
cut of each node follows from running sums over its bins, and so do the means on either
side. The rows are written once. What is kept of a tree is a row of its nodes; a level
takes each cell down the nodes above it anew. Rows get the prediction of their cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from haplospark.operators.stored import stored, written

#: Gains at or below this are no cut.
LEAST_GAIN = 1e-9
#: Edges of all features that are shared by the tasks.
MAX_EDGES = 1 << 20
#: Nodes of all trees that are broadcast; beyond, the rows meet them in a shuffled join.
MAX_NODES = 1 << 18
#: Boosting rounds after which what is predicted so far is written, to bound the plan.
ROUNDS = 8
#: Trees of a forest whose sums are taken in one pass over the rows.
TREES = 8


def binned(rows: DataFrame, features: str, bins: int = 32, train: str = "train") -> DataFrame:
    """rows with bins array<int>: for each feature how many of its training quantiles lie below the value.

    features is an array of one length without nulls; one row of edges is shared by the tasks, and its size is checked.
    """
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    each = rows.where(train).select(F.posexplode(features).alias("f", "v")).groupBy("f").agg(F.array_distinct(F.percentile_approx("v", at, 10_000)).alias("e"))
    width = rows.select(F.size(features)).first()
    if width is not None and width[0] * bins > MAX_EDGES:
        raise ValueError(f"{width[0]} features of {bins} bins; {MAX_EDGES} edges are shared at most")
    edges = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "e"))), lambda s: s["e"]).alias("edges_"))  # a row a feature
    cut = F.transform(features, lambda v, k: F.size(F.filter(F.get("edges_", k), lambda e: e < v)))
    return rows.join(F.broadcast(edges)).withColumn("bins", cut).drop("edges_")


def _cuts(active: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, cut, value, left, right): the mean of each node, its best cut and the means on its sides.

    Of equal cuts it is the lowest feature and bin; rows at bin cut or below go left. Without a cut feature is null.
    """
    each = active.where("w > 0").select(*keys, "w", "wt", F.posexplode_outer("bins").alias("feature", "bin"))
    sums = each.groupBy(*keys, "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wt").alias("wt"))
    own = W.partitionBy(*keys, "feature")  # a row a bin
    upto = own.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    sides = sums.select(*keys, "feature", "bin", F.sum("w").over(upto).alias("a"), F.sum("wt").over(upto).alias("x"), F.sum("w").over(own).alias("n"), F.sum("wt").over(own).alias("s"))
    a, x, n, s = (F.col(c) for c in ("a", "x", "n", "s"))
    gain = F.round(x * x / a + (s - x) * (s - x) / (n - a) - s * s / n, 9)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (x / a).alias("left"), ((s - x) / (n - a)).alias("right"))
    best = sides.groupBy(*keys).agg(F.max(F.when(n - a > 1e-9, cut)).alias("c"), F.min(F.struct("feature", "bin", (s / n).alias("value"))).alias("r"))
    found = F.when(F.col("c.gain") > LEAST_GAIN, F.col("c"))
    return best.select(*keys, (-found["f"]).alias("feature"), (-found["b"]).alias("cut"), F.col("r.value").alias("value"), found["left"].alias("left"), found["right"].alias("right"))


def _packed(nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, tree_): of each tree an array of its inner nodes, numbered from the root, 1; null where there is none."""
    held = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", "feature", "cut", "value", "left", "right")).alias("held"))  # the nodes of a tree
    places = F.sequence(F.lit(1), F.lit(max(1, (1 << depth) - 1)))
    return held.select(*keys, F.transform(places, lambda k: F.get(F.filter("held", lambda h: h["node"] == k), F.lit(0))).alias("tree_"))


def _met(rows: DataFrame, model: DataFrame, by: list[str], nodes: int, how: str = "left") -> DataFrame:
    """rows joined to a model of so many nodes a row."""
    return rows.join(F.broadcast(model) if model.count() * nodes <= MAX_NODES else model, by, how)


def _taken(rows: DataFrame, depth: int) -> DataFrame:
    """rows(bins, tree_) with node and value: where they are after depth steps from the root, and the mean there."""
    rows = rows.withColumn("node", F.lit(1)).withColumn("value", F.get("tree_", F.lit(0))["value"])
    for _ in range(depth):
        at = F.get("tree_", F.col("node") - 1)
        right, stays = F.get("bins", at["feature"]) > at["cut"], at["feature"].isNull()
        node = F.when(stays, F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))
        rows = rows.withColumns({"node": node, "value": F.when(stays, F.col("value")).when(right, at["right"]).otherwise(at["left"])})
    return rows


def _grown(rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, tree_): the tree of each key over rows(keys, w, wt, bins), wt being weight times target; read once a level."""
    found: DataFrame | None = None
    for level in range(max(1, depth)):
        if found is None:
            active = rows.withColumn("node", F.lit(1))
        else:
            active = _taken(_met(rows, _packed(found, keys, depth), keys, 1 << depth, "inner"), level)
        # a filter before it is stored would go down through all steps, and each holds the one before it several times
        cuts = stored(_cuts(active, [*keys, "node"])).where(F.col("node") >= (1 << level))
        found = cuts if found is None else found.unionByName(cuts)
    if not depth:
        found = found.withColumn("feature", F.lit(None).cast("int"))
    return stored(_packed(found, keys, depth))


def _end(tree: Column, depth: int) -> Column:
    """The mean of the leaf that a row of bins ends in; as _taken, for any number of trees."""

    def step(end: Column, _: Column) -> Column:
        at = F.get(tree, end["node"] - 1)
        right = F.get("bins", at["feature"]) > at["cut"]
        below = F.struct((2 * end["node"] + right.cast("int")).alias("node"), F.when(right, at["right"]).otherwise(at["left"]).alias("value"))
        return F.when(at["feature"].isNull(), end).otherwise(below)

    root = F.struct(F.lit(1).alias("node"), F.get(tree, F.lit(0))["value"].alias("value"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), root, step)["value"]


def drawn_weight(*parts: Column) -> Column:
    """How often a row is drawn: Poisson with mean 1, from a hash of parts; in place of as many draws as there are rows."""
    return _poisson(_drawn(*parts))


def _drawn(*parts: Column) -> Column:
    """32 bits in hex, which are ordered as text."""
    return F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8)


def _poisson(drawn: Column) -> Column:
    weight, total, term = F, 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        edge = math.ceil(total * (1 << 32))
        if edge >= 1 << 32:
            return weight.otherwise(F.lit(float(k)))
        weight = weight.when(drawn < f"{edge:08x}", F.lit(float(k)))
        term /= k + 1
    return weight.otherwise(F.lit(12.0))


def _prepared(rows: DataFrame, by: list[str], id_col: str, target: str, train: str) -> DataFrame:
    learned = F.coalesce(F.expr(train), F.lit(False)) & F.col(target).isNotNull()
    bins = F.coalesce("bins", F.array().cast("array<int>"))
    return rows.select(*by, F.col(id_col).alias("id_"), F.col(target).cast("double").alias("y"), learned.alias("learned"), bins.alias("bins"))


def _drawn_cells(base: DataFrame, by: list[str], trees: range, seed: int) -> DataFrame:
    """(by, bins, sums): for each of trees the weight that it drew of a cell's training rows, and that times their targets."""
    hashes = F.array(*[_drawn(F.lit(seed), F.lit(tree), *[F.col(c) for c in by], F.col("id_")) for tree in trees])
    drawn = base.withColumn("drawn", F.when(F.col("learned"), hashes))
    drawn = drawn.withColumn("drawn", F.transform("drawn", _poisson))  # null for what is held out
    at = [F.get("drawn", F.lit(k)) for k in range(len(trees))]
    sums = [F.struct(F.lit(tree).alias("tree"), F.sum(w).alias("w"), F.sum(F.when(w > 0, w * F.col("y"))).alias("wt")) for tree, w in zip(trees, at)]
    return written(drawn.groupBy(*by, "bins").agg(F.array(*sums).alias("sums")))


def forest(rows: DataFrame, by: list[str], trees: int, depth: int, id_col: str = "sample", target: str = "y", train: str = "train", seed: int = 0) -> DataFrame:
    """(by, id, target, predicted) of all rows: the mean of trees grown on rows drawn with replacement, a forest for each group.

    rows has bins (see binned). A tree that drew none of a group's training rows has no say; a group without any is predicted null.
    """
    base = written(_prepared(rows, by, id_col, target, train))
    drawn = [_drawn_cells(base, by, range(k, min(k + TREES, trees)), seed) for k in range(0, trees, TREES)]
    each = reduce(DataFrame.unionByName, drawn).select(*by, "bins", F.inline("sums")).where("w > 0")
    grown = _grown(each, [*by, "tree"], depth).groupBy(*by).agg(F.collect_list("tree_").alias("trees_"))  # the trees of a group
    met = _met(drawn[0].select(*by, "bins"), grown, by, trees << depth, "inner")
    mean = F.aggregate(F.transform("trees_", lambda tree: _end(tree, depth)), F.lit(0.0), lambda s, v: s + v) / F.size("trees_")
    found = base.join(met.select(*by, "bins", mean.alias("predicted")), [*by, "bins"], "left")
    return found.select(*by, F.col("id_").alias(id_col), F.col("y").alias(target), "predicted")


def boosted(rows: DataFrame, by: list[str], rounds: int, depth: int, rate: float = 0.1, id_col: str = "sample", target: str = "y", train: str = "train") -> DataFrame:
    """(by, id, target, predicted) of all rows: the training mean and rounds trees, each grown on what is left and added by rate."""
    base = written(_prepared(rows, by, id_col, target, train))
    cells = written(base.groupBy(*by, "bins").agg(F.count_if("learned").cast("double").alias("w"), F.sum(F.when(F.col("learned"), F.col("y"))).alias("s")))
    means = stored(cells.where("w > 0").groupBy(*by).agg((F.sum("s") / F.sum("w")).alias("predicted")))
    state = _met(cells, means, by, 1, "inner")
    for k in range(rounds):
        left = state.where("w > 0").withColumn("wt", F.col("s") - F.col("w") * F.col("predicted"))
        after = _taken(_met(state, _grown(left, by, depth), by, 1 << depth), depth)
        state = after.withColumn("predicted", F.col("predicted") + rate * F.coalesce("value", F.lit(0.0))).drop("value", "node", "tree_")
        if k % ROUNDS == ROUNDS - 1:
            state = written(state)
    found = base.join(state.select(*by, "bins", "predicted"), [*by, "bins"])
    return found.select(*by, F.col("id_").alias(id_col), F.col("y").alias(target), "predicted")
