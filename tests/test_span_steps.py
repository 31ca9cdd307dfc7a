"""Spans are cut in one pass and verified in time that grows with their texts."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import rules, segment, support
from factloom.plans import catalog

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["m_spans", "m_span_kind_counts", "p_claim_rules", "p_evidence_rules"])
def test_texts_are_cut_once(spark, name):
    plan = _plan(catalog.queries()[name](spark, D))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    # what spans keep of their documents is joined to the texts, below the cut
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_spans_of_odd_texts(spark):
    texts = ["a.\x85b. c\u2028", "- \n12.  x.y z", "\r\n    code! now\r* ||", "。。x。 y.\x85", "\x1c\x0b .", None]
    df = spark.createDataFrame(list(enumerate(texts)), "unit long, content string").withColumn("first", F.lit(7))
    got = [tuple(r)[1:] for r in segment.span_rows(df, "unit", "content", F.col("first"), "first").orderBy("evidence_unit_id", "start_offset").collect()]
    assert got[:4] == [(0, 2, 7, "a.", "prose", 7), (2, 3, 7, "\x85", "prose", 7), (3, 5, 8, "b.", "prose", 7), (6, 8, 8, "c\u2028", "prose", 7)]
    assert all(texts[r[0]][r[1] : r[2]] == r[4] for r in map(tuple, segment.span_rows(df, "unit", "content", F.col("first")).collect()))


def test_units_are_not_joined_to_each_of_their_spans(spark):
    plan = _plan(catalog.queries()["p_span_rules"](spark, D))
    assert "Join" not in plan and "substring(unit" not in plan


def test_span_rules_on_odd_rows(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    units = spark.createDataFrame([(1, "a\nbc", 1), (1, "a\nb", 1), (2, None, 1), (None, "a", 1)], "evidence_unit_id long, content string, start_line int")
    spans = [("good", 1, 0, 1, 1, "a", sha("a")), ("one of two", 1, 2, 4, 2, "bc", sha("bc")), ("line", 1, 2, 3, 1, "b", sha("b")), ("digest", 1, 0, 1, 1, "a", sha("b")), ("no text", 2, 0, 1, 1, "a", sha("a")),
             ("no unit", 3, 0, 1, 1, "a", sha("b")), ("no id", None, 0, 1, 1, "a", sha("a")), ("null", 1, None, 1, None, "a", None), ("from the end", 1, -2, -1, 1, "c", sha("c"))]
    df = spark.createDataFrame(spans, "evidence_span_id string, evidence_unit_id long, start_offset long, end_offset long, start_line int, content string, content_sha256 string")
    got = rules.span_rules(df, units)
    assert got.columns == ["rule_code", "record_id", "detail"]
    want = [("one of two", "text"), ("line", "line"), ("line", "line"), ("digest", "digest"), ("digest", "digest"), ("no text", "text"), ("no unit", "text"), ("no unit", "digest"), ("no id", "text"), ("from the end", "text")]
    assert sorted((r.record_id, r.detail) for r in got.collect()) == sorted(want)


def test_claims_of_one_id_do_not_repeat_their_qualifiers(spark):
    row = "canonical_claim_id string, supporting array<string>, opposing array<string>, time string, scope string, conditions array<string>"
    canonical = spark.createDataFrame([("cc", ["a"], [], None, "en", []), ("cc", [], ["b"], None, "de", [])], row)
    claims = spark.createDataFrame([("a", None, "de", []), ("b", None, "de", ["c"])], "evidence_claim_id string, time string, scope string, conditions array<string>")
    assert sorted(r.detail for r in rules.qualifier_rules(canonical, claims).collect()) == ["a", "b"]


def test_edges_are_taken_from_claims(spark):
    for name in ("a_support_counts", "a_epistemic_status"):
        plan = _plan(catalog.queries()[name](spark, D))
        assert "Generate" not in plan and "ObjectHashAggregate" not in plan and "evidence_claim_id" not in plan
    plan = _plan(catalog.queries()["g_dangling"](spark, D))
    assert "Join" not in plan and "statement" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4, 5, None], [2, 2, 3, 3, 3, 6, None]])
def test_counts_of_documents_that_share_an_id(spark, tmp_path, ids):
    texts = ["A b. Xa c.", "A b. Other d!", "A b.\nXa c.\nA b.", "Last e. A b.", None, "Sole f.", "Of no id."]
    rows = list(zip(ids, texts, ["en", "de", "en", None, "en", "fr", "en"], ["s", "t", "s", "t", "u", None, "u"]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("a_support_counts", "a_epistemic_status", "a_status_pivot", "p_hidden_status", "g_dangling", "m_span_kind_counts"):
        got, want = catalog.queries()[name](spark, str(tmp_path)), duck.sql(catalog.oracle_sql()[name])
        assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall())), name


@pytest.mark.parametrize("name", ["p_hidden_status", "a_status_pivot", "a_epistemic_status"])
def test_statuses_take_one_pass(spark, name):
    plan = _plan(catalog.queries()[name](spark, D))
    # from documents to the result: texts are cut here, no step is stored and read again, nothing is joined
    assert plan.count("MapInArrow") == 1 and "step-" not in plan and "Join" not in plan and plan.count("Exchange") <= 5


def test_statuses_of_statements_that_share_an_id(spark):
    row = "statement_id string, derived boolean, superseded boolean, opposing boolean, independence_group_id string, evidence_origin string, primary_support_status string"
    own, note = ("primary-source", "verified"), ("derived-note", None)
    claims = spark.createDataFrame([
        ("a1", False, False, False, "g", *own), ("a2", False, False, False, "h", *own), ("a2", False, False, False, "h", *own),
        ("b1", False, False, False, "g", *note), ("b2", False, False, True, "g", *note), ("c1", False, False, False, "g", *note), ("c1", False, False, False, "g", *own),
        ("d1", True, False, True, "g", *own), ("d2", True, False, False, None, *own), ("e1", False, True, True, None, *own), ("f1", False, False, False, None, *own), ("h1", False, False, False, None, *note),
    ], row)
    got = {r.statement_id: (r.canonical_claim_id, r.status) for r in support.statuses(claims, F.substring("statement_id", 1, 1)).collect()}
    want = {"a1": "multi-source", "a2": "multi-source", "b1": "derived-note-only", "b2": "disputed", "c1": "single-source", "d1": "disputed", "d2": "single-source", "e1": "superseded", "f1": "insufficient-evidence", "h1": "derived-note-only"}
    assert got == {k: (k[0], v) for k, v in want.items()}
