"""Offsets of lines and pieces."""

import random

import pyarrow as pa

from factloom.operators import segment


def test_running_sums_of_lists():
    lists = [[3, 1, 2], [], [5], [0, 0, 7, 1]]
    for at in range(4):
        got = segment._begins(pa.array(lists, pa.list_(pa.int32())).slice(at)).to_pylist()
        assert got == [[sum(x[:i]) for i in range(len(x))] for x in lists[at:]]
    assert segment._begins(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_offsets_point_at_the_content(spark):
    rng = random.Random(5)
    texts = ["", None, "One. Two! Three?\n\n- item one. two\n\tcode é\U0001f600. x", "\n".join(rng.choice(["A b. C d.", "", "  x", "é。ü", "* l"]) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "unit long, content string")
    rows = segment.span_rows(df.selectExpr("unit", "content", "1 AS first"), "unit", "content", spark_first()).collect()
    assert {r.evidence_unit_id for r in rows} == {2, 3} and len(rows) > 3000
    assert all(texts[r.evidence_unit_id][r.start_offset : r.end_offset] == r.content for r in rows)
    assert all(texts[r.evidence_unit_id].split("\n")[r.line - 1].find(r.content) >= 0 for r in rows)


def spark_first():
    from pyspark.sql import functions as F

    return F.col("first")


def test_texts_without_spans_and_full_stops_in_a_row():
    def cut(*texts):
        rows = pa.record_batch({"_text": pa.array([t.encode() for t in texts], pa.binary()), "_first": pa.array([1] * len(texts), pa.int64())})
        return [(r["line"], r["start_offset"], r["end_offset"], r["content"]) for b in segment._cut(iter([rows])) for r in b.to_pylist()]

    assert cut("", " \n\t", "- ") == cut() == []
    assert cut("。 ！a.b? c!  ", "- x.\x85\n  y") == [(1, 0, 1, "。"), (1, 2, 3, "！"), (1, 3, 7, "a.b?"), (1, 8, 10, "c!"), (1, 2, 4, "x."), (1, 4, 5, "\x85"), (3, 8, 9, "y")]
