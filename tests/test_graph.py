"""Cycle edges against plain peeling."""

import random

from factloom.operators import graph


def plain(pairs):
    now = {(a, b) for a, b in pairs if a is not None and b is not None}
    while True:
        src, dst = {a for a, _ in now}, {b for _, b in now}
        kept = {(a, b) for a, b in now if a in dst and b in src}
        if kept == now:
            return kept
        now = kept


def found(spark, pairs, trace=None):
    df = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
    rows = [tuple(r) for r in graph.cycle_edges(df, trace).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def shapes():
    chain = lambda name, n: [(f"{name}{i}", f"{name}{i + 1}") for i in range(n)]
    ring = chain("r", 30) + [("r30", "r0")]
    yield "two rings with a chain between", ring + chain("q", 20) + [("q20", "q0"), ("r5", "c0"), ("c25", "q7")] + chain("c", 25)
    yield "tails that enter and leave", ring + chain("in", 40) + [("in40", "r3"), ("r9", "out0")] + chain("out", 40)
    yield "diamonds", [(f"d{i}", f"d{i}{s}") for i in range(20) for s in "ab"] + [(f"d{i}{s}", f"d{i + 1}") for i in range(20) for s in "ab"] + [("d20", "d0"), ("d3", "d4")]
    yield "loops, pairs, nulls and repeats", [("x", "x"), ("y", "z"), ("z", "y"), ("y", "z"), (None, "a"), ("a", None), ("x", "y"), ("t", "x")]
    yield "a ladder", [(f"a{i}", f"a{i + 1}") for i in range(12)] + [(f"b{i}", f"b{i + 1}") for i in range(12)] + [(f"a{i}", f"b{i}") for i in range(13)] + [(f"b{i}", f"a{i + 1}") for i in range(12)]
    yield "nothing", []


def test_shapes_and_random_graphs(spark):
    """All at once, as parts of one graph that do not touch."""
    pairs = [(a and f"{n}:{a}", b and f"{n}:{b}") for n, part in shapes() for a, b in part]
    for seed in range(6):
        rng = random.Random(seed)
        pairs += [(f"{seed}-{rng.randrange(60)}", f"{seed}-{rng.randrange(60)}") for _ in range(65)]
    assert found(spark, pairs) == plain(pairs) != set()
    assert found(spark, []) == set()


def test_a_long_chain_takes_few_rounds(spark):
    """A chain of 900 nodes, and one that ends in a ring of 300."""
    trace = []
    chain = spark.range(900).selectExpr("cast(id as string) AS src", "cast(id + 1 as string) AS dst")
    into = spark.range(900).selectExpr("concat('r', id) AS src", "CASE WHEN id = 899 THEN 'r600' ELSE concat('r', id + 1) END AS dst")
    got = {r.src for r in graph.cycle_edges(chain.unionByName(into), trace).collect()}
    assert got == {f"r{i}" for i in range(600, 900)}
    assert len(trace) <= 14
