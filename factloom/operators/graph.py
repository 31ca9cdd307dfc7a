"""Provenance and supersession graphs: edges, dangling nodes, acyclicity by peeling and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.rules import exploded
from factloom.session import written


def provenance_edges(canonical: DataFrame) -> DataFrame:
    """(src, dst, type): evidence to claims it supports or opposes, parents to claims derived from them."""
    edges = exploded(canonical, "canonical_claim_id", "type", {"supporting": "supports", "opposing": "opposes", "derived_from": "derived-from"})
    return edges.select(F.col("item").alias("src"), F.col("canonical_claim_id").alias("dst"), "type")


def supersession_edges(canonical: DataFrame) -> DataFrame:
    """(src, dst) from newer to older, each once, whichever side declares it."""
    a = canonical.select(F.col("canonical_claim_id").alias("src"), F.explode("supersedes").alias("dst"))
    b = canonical.select(F.explode("superseded_by").alias("src"), F.col("canonical_claim_id").alias("dst"))
    return a.unionByName(b).distinct()


def dangling(edges: DataFrame, nodes: DataFrame, prefix: str = "cc_") -> DataFrame:
    """Claim nodes of edges that are no known claim."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(False).alias("known"))
    both = ends.unionByName(nodes.select("node", F.lit(True).alias("known"))).where(F.col("node").startswith(prefix))
    return both.groupBy("node").agg(F.bool_or("known").alias("known")).where(~F.col("known")).select("node")


def _peeled(edges: DataFrame) -> DataFrame:
    """Without the edges out of nodes without predecessors and into nodes without successors, twice."""
    for _ in range(2):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return edges.select("src", "dst")


def _splices(edges: DataFrame, seed: int) -> DataFrame:
    """(node, p, s): nodes with one predecessor p and one successor s, no two of them neighbours.

    Of the nodes of a chain those are taken whose hash is less than their neighbours', a third on average and
    one at least; a new seed takes others.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("p"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("s"))
    inner = ins.join(outs, "node").where("n_in = 1 AND n_out = 1 AND p != node").select("node", "p", "s", F.xxhash64("node", F.lit(seed)).alias("h"))
    by = lambda side: inner.select(F.col("node").alias(side), F.col("h").alias(f"h_{side}"))
    near = inner.join(by("p"), "p", "left").join(by("s"), "s", "left")
    return near.where("(h_p IS NULL OR h < h_p) AND (h_s IS NULL OR h < h_s)").select("node", "p", "s")


def _contracted(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """The edges with each node of ``cut`` replaced by one edge from its predecessor to its successor."""
    rest = edges
    for end in ("src", "dst"):
        rest = rest.join(cut.select(F.col("node").alias(end)), end, "left_anti")
    return rest.select("src", "dst").unionByName(cut.select(F.col("p").alias("src"), F.col("s").alias("dst"))).distinct()


#: Rounds of peeling alone, which end shallow graphs at less cost.
SHALLOW = 3


def cycle_edges(edges: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """The edges that lie on cycles or between them; empty for an acyclic graph.

    Each round peels nodes that no cycle reaches or that reach none, and contracts chains: of the nodes with
    one predecessor and one successor a large part gives way to an edge. Trees, chains and cycles of any
    length so take a logarithmic number of rounds; a graph that has neither ends nor chains to take away
    loses its outer nodes round by round. What is left at the end are the edges wanted, in which the contracted
    nodes are put back in reverse order. Every round is written to the checkpoint folder, which
    executors share, so that plans stay short and survive lost executors. Edges with a null end are
    no edges; repeated ones count once. trace gets the number of edges after each round.
    """
    now = written(edges.select("src", "dst").dropna().distinct())
    left, levels, seed, rounds = now.count(), [], 0, 0
    while left:
        rounds += 1
        now = written(_peeled(now))
        after = now.count()
        if trace is not None:
            trace.append(after)
        if after == left:
            break
        left = after
        while left and rounds > SHALLOW and seed < 2 * (rounds - SHALLOW):
            seed += 1
            cut = written(_splices(now, seed))
            levels.append((now, cut))
            now = written(_contracted(now, cut))
            left = now.count()
    if left:
        for before, cut in reversed(levels):
            direct = before.join(now, ["src", "dst"], "left_semi")
            inside = cut.join(now.toDF("p", "s"), ["p", "s"], "left_semi")
            now = written(direct.select("src", "dst").unionByName(inside.select(F.col("p").alias("src"), F.col("node").alias("dst"))).unionByName(inside.select(F.col("node").alias("src"), F.col("s").alias("dst"))))
    return now


def is_acyclic(edges: DataFrame) -> bool:
    return cycle_edges(edges).isEmpty()


def records(edges: DataFrame, supersession: DataFrame, claims: DataFrame) -> DataFrame:
    """(part, src, dst, type): the dependency graph a row at a time, however large: nodes, provenance
    edges and supersession edges. Nodes are the claims and all ends of edges."""
    ends = edges.select(F.array("src", "dst").alias("n")).unionByName(supersession.select(F.array("src", "dst").alias("n")))
    nodes = ends.select(F.explode("n").alias("src")).unionByName(claims.select(F.col("canonical_claim_id").alias("src"))).distinct()
    none = F.lit(None).cast("string")
    return (
        nodes.select(F.lit("node").alias("part"), "src", none.alias("dst"), none.alias("type"))
        .unionByName(edges.select(F.lit("edge").alias("part"), "src", "dst", "type"))
        .unionByName(supersession.select(F.lit("supersession").alias("part"), "src", "dst", none.alias("type")))
    )


def export(edges: DataFrame, supersession: DataFrame, claims: DataFrame) -> DataFrame:
    """One row (graph) with the sorted node and edge lists as JSON: the dependency graph record.

    Meant for the claims of one knowledge base, a report of bounded size; ``records`` has no bound.
    """
    rows = records(edges, supersession, claims)
    of = lambda part, value: F.sort_array(F.collect_list(F.when(F.col("part") == part, value)))
    ends = (F.col("src").alias("from"), F.col("dst").alias("to"))
    lists = rows.agg(of("node", F.col("src")).alias("nodes"), of("edge", F.struct(*ends, "type")).alias("edges"), of("supersession", F.struct(*ends)).alias("supersession_edges"))
    return lists.select(F.to_json(F.struct("nodes", "edges", "supersession_edges")).alias("graph"))
