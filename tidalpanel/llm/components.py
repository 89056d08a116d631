"""Connected components of a link table, by alternating large and small stars.

No task sees more than the links of its own keys, those of hubs stay where they are
(shared.heavy_join), minima combine before the shuffle, and every round is written to the shared folder. Links that are
stars already take no round, so no last one only repeats its predecessor. Nothing of the graph
reaches the driver but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.shared import discard, heavy_join, stage


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return heavy_join(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them.

    After a large star a node has few smaller neighbours, so no key is heavy."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    """How many links (a, b), a > b, there are, and how many nodes keep them from being stars around their smallest nodes."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if(F.expr("up + down > 1 and up > 0")).alias("open")).first()
    return row["n"], row["open"]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b), in either direction, repeats and self links allowed, any orderable
    type -> (node, root): root is the smallest node reachable. Nodes without a link to
    another node have no row. An empty table gives an empty table."""
    down = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(down.distinct(), "links")
    total, still_open = _state(now)
    for _ in range(most_rounds):
        if not still_open:
            break
        before, now = now, stage(_small_star(_large_star(now, total)), "links")
        discard(before)
        total, still_open = _state(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
