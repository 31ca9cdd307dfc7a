"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two aggregate-and-join steps; the aggregates combine before the shuffle, and the
joins are plain equi-joins that adaptive execution may split, so a hub with a third of all edges
is no single task's work. Every round is a written table: lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Stash


def _links(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(stash: Stash, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node with a link; root is the least node that it reaches.

    Takes columns u and v of one orderable type; loops and repeated or reversed links do no harm,
    links with a null end are no links, and an empty table gives an empty one.
    """
    now = stash.put(_links(edges.select("u", "v").dropna()))
    seen = None
    for _ in range(rounds):
        new = stash.put(_links(_small_star(_links(_large_star(now)))))
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.min("u")).first()
        stash.drop(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
