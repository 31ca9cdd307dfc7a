"""Article queries against their SQL on pages whose escaped text was cut within a reference."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from factloom.plans import catalog

TITLES = ("plain", "cut&amp;&amp", "cut&am", "cut&", "a &lt;b&gt; &quot;c&quot;", "cut&lt", "&#35 and &#x23")


@pytest.mark.parametrize("name", ["m_article_score", "m_article_extract"])
def test_references_without_their_end_are_text(spark, tmp_path, name):
    page = "<html><head></head><body><article><h1>%s</h1><p><b>%s\n</b></p><p>body &amp; more</p></article></body></html>"
    rows = [(i, f"https://a.example/{i}", page % (t, t)) for i, t in enumerate(TITLES)]
    pq.write_table(pa.table([pa.array(c) for c in zip(*rows)], names=["page_id", "url", "html"]), tmp_path / "pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = c.sql(f"SELECT page_id, title FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [(r.page_id, r.title) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
