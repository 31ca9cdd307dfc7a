"""Costly steps run once a query, over rows dealt to all cores, and hold one frame at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import frames, rules
from factloom.plans import catalog
from factloom.session import spread

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [
    ("p_claim_rules", 2), ("p_evidence_rules", 2), ("p_span_rules", 2), ("j_disposition_rules", 0), ("a_support_counts", 0), ("a_status_pivot", 0),
    ("g_export", 0), ("p_qualifiers", 0), ("i_carry_forward", 0), ("j_claim_provenance", 0), ("p_page_front_matter", 0),
])
def test_python_steps_of_a_plan(spark, name, most):
    plan = catalog.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= most


def test_spread_fills_all_cores(spark):
    few = spark.range(100).repartition(spark.sparkContext.defaultParallelism + 1)
    assert spread(few).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_rules_of_one_pass_are_those_of_several(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (None, "a")], "k int, v string")
    each = [("ONE", F.col("k"), F.col("k") > 1, F.col("v")), ("TWO", F.col("k"), F.col("v") == "a")]
    want = rules.union(*(rules.violations(df, *r) for r in each))
    got = rules.violated(df, *each)
    assert got.schema.names == want.schema.names
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_frames_are_made_one_at_a_time(spark):
    def draw(i):
        a = np.zeros((180, 320, 3), np.uint8)
        a[i + 4 : i + 148, i + 6 : i + 262] = 230
        return a.tobytes()

    got = spark.range(5).select("id", frames.bounds_of(320, 180, draw)("id").alias("b")).collect()
    for r in got:
        w = frames.slide_bounds(draw(r.id), 320, 180)
        assert tuple(r.b[c] for c in ("confidence", "height", "width", "x", "y")) == pytest.approx(tuple(w))
