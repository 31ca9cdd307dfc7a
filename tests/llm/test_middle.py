import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import middle, queries

SCHEMA = "doc_id long, text string, output string, n string, h1 string"


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = c.sql(queries.oracle_sql()["op12_fill_in_middle"])
    found = queries.op12_fill_in_middle(spark, d)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_odd_texts(spark):
    texts = [None, "", "a", "<", ">", "<P", "P>", "<P>", "a<S>b", "x<M>", "\n\r\n  \t", "é\U0001f600é\U0001f468‍\U0001f469", "<<P<>S><", "M>" * 50, "\U0001f600" * 300, "ab " * 40_000, "\x00 \x85"]
    rows = [(i, t, "x", None, "y") for i, t in enumerate(texts * 12)] + [(None, t, None, None, None) for t in texts] * 2
    found = middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    got = found.select("row.doc_id", "row.text", "n", "form", "prefix_units", "middle_units", "output", middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == plain(r[0], r[1])
        assert r[7] == (r[1] or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units(spark, unit):
    texts = ["one two\n\nthree  ", " lead", "\n", "a\nb\nc", "<P> x", "w " * 500]
    rows = [(i, texts[i % 6], None, None, None) for i in range(120)]
    found = middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit=unit, percent=100)
    got = found.select("row.text", "form", "output", middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == r.text for r in got)
    assert {r.text for r in got if r.form == "plain"} == {"<P> x"}
    ends = {"words": " \n", "lines": "\n"}[unit]
    assert all(r.output[3:].partition("<")[0][-1:] in ("", *ends) for r in got if r.form == "psm" and "<M>" in r.output and r.output.split("<S>")[1] not in ("<M>",))


def test_no_python_and_one_pass_over_the_units(spark):
    df = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 1


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
