"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation to the smallest neighbour and a join back, so a hub with
very many links is combined on the map side and its join can be split by AQE; no
neighbour list is ever gathered into one row. Each round is written to the shared
folder, which cuts the lineage. Joins are merge joins: a packed file of links that is small
enough to be broadcast is many times larger as a hash table in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where("v > u").join(least.hint("merge"), "u").where("v <> m")
    return up.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b throughout, as the large step leaves them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least).distinct()


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node reached.

    No links give no rows. It ends when a round leaves every link as it was. Raises if
    max_rounds do not suffice (each round at least halves long chains, so that is beyond any table).
    """
    state = materialise(links.toDF("a", "b").where("a <> b").distinct())
    size = state.count()
    for _ in range(max_rounds):
        before, state = state, materialise(_small_star(_large_star(state)))
        last, size = size, state.count()
        if last == size and state.join(before.hint("merge"), ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = state.toDF("node", "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
