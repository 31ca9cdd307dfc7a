import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import hashing, text, timecode, urls
from factloom.sources import images


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_stable_ids_and_canonical_json(spark):
    import hashlib

    want = "src_" + hashlib.sha256("a\x1fé\x1f".encode()).hexdigest()[:20]
    assert values(spark, "a string, b string, c string", [("a", "é", None)], hashing.stable_id("src", F.col("a"), F.col("b"), F.col("c"))) == [(want,)]
    got = values(spark, "j string", [('{"b": [1, 2.5], "a": {"d": null, "c": "é"}}',), (None,)], hashing.canonical_json("j"))
    assert got == [('{"a":{"c":"é","d":null},"b":[1,2.5]}',), (None,)]


def test_fingerprint_ignores_row_order_and_sees_every_change(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "id long, t string")
    f = lambda df: hashing.fingerprint(df, "id").first()[0]
    assert f(a) == f(a.orderBy(F.desc("id")).repartition(5)) != f(a.withColumn("t", F.when(F.col("id") == 7, "x").otherwise(F.col("t"))))


@settings(max_examples=20, deadline=None)
@given(st.text("abcXYZ0189", min_size=1, max_size=20))
def test_url_normal_form(segment):
    import pandas as pd

    one = urls.normalize.__wrapped__
    assert one(pd.Series([f"HTTPS://Example.COM:443/{segment}/#section"]))[0] == f"https://example.com/{segment}"


def test_urls(spark):
    import pandas as pd

    n = urls.normalize.__wrapped__(pd.Series([" http://u:p@H.x:8080//a//b/?b=2&a=&c=%20#f", "ftp://x/", "nonsense", "https://[::1]:443", None, "http://h:99999999/"]))
    assert n.tolist() == ["http://h.x:8080/a/b?a=&b=2&c=+", None, None, "https://[::1]/", None, None]
    rows = [("https://x.com/a/status/1?s=20&utm_source=q&k=v#f",), ("https://Blog.example/p?utm_medium=1",), ("https://www.langchain.com/blog/x?s=1",)]
    a = urls.adapter(urls.host(F.col("u")))
    assert values(spark, "u string", rows, a, urls.canonicalize(F.col("u"), a)) == [
        ("x-article", "https://x.com/a/status/1?k=v"), ("generic-article", "https://blog.example/p"), ("langchain-blog", "https://www.langchain.com/blog/x?s=1")]
    hosts = ["localhost", "a.local", "10.1.2.3", "172.31.0.1", "172.32.0.1", "100.64.0.1", "198.19.1.1", "224.0.0.1", "8.8.8.8", "[::1]", "fe80::1", "fec0::1", "example.com", "999.1.1.1"]
    assert [r[0] for r in values(spark, "h string", [(h,) for h in hosts], urls.is_private(F.col("h")))] == [True, True, True, True, False, True, True, True, False, True, True, False, False, False]
    refused = ["https://u:p@x.com/", "https://10.0.0.1/", "http://x.com/", "https://x.com/", "x"]
    assert [r[0] for r in values(spark, "u string", [(u,) for u in refused], urls.source_url_problem(F.col("u")))] == ["credentials", "private", "not-https", None, "invalid"]
    videos = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=3", "https://www.youtube.com/shorts/abcdefghijk", "https://youtube.com/playlist?list=x", "http://youtu.be/abcdefghijk", "https://youtu.be/short"]
    assert [r[0] for r in values(spark, "u string", [(u,) for u in videos], urls.video_id(F.col("u")))] == ["abcdefghijk"] * 2 + [None] * 4
    assert [r[0] for r in values(spark, "p string", [("a/b",), ("/a",), ("a/../b",), ("",), (None,), ("a..b",)], urls.is_safe_relative(F.col("p")))] == [True, False, False, False, False, True]


def test_names_and_scalars(spark):
    titles = ["a: b/c?", "", None, " ... ", "x" * 200]
    assert [r[0] for r in values(spark, "t string", [(t,) for t in titles], text.document_stem(F.col("t")))] == ["a - b c", "Untitled", "Untitled", "Untitled", "x" * 120]
    scalars = ["plain", "a: b", "#x", "true", "12.5", "", None, "a #b", "- x", 'say "hi"', "line\nbreak"]
    want = ["plain", json.dumps("a: b"), json.dumps("#x"), '"true"', '"12.5"', "", "", json.dumps("a #b"), json.dumps("- x"), 'say "hi"', json.dumps("line\nbreak")]
    assert [r[0] for r in values(spark, "t string", [(t,) for t in scalars], text.yaml_scalar("t"))] == want
    assert values(spark, "t string", [("**Bold** [x](y) \\_ ﬁ `c`",)], text.heading_text(F.col("t"))) == [("Bold x ﬁ c".replace("ﬁ", "fi").replace("x ", "x  ").replace("  ", " "),)]
    assert values(spark, "t string", [("00:01:02,500",), ("01:02.250",), ("x",)], timecode.caption_seconds(F.col("t"))) == [(62.5,), (62.25,), (None,)]


def test_front_matter_round_trip(spark):
    rows = [("T: x", "a", "https://h/", "2024-01-01", "2024-01-01T00:00:00")]
    names = ("title", "author", "source_url", "published", "captured")
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(F.concat(text.front_matter(*(F.col(n) for n in names)), F.lit("body\n")).alias("m"))
    got = df.select(text.strict_front_matter(F.col("m")).alias("f")).select("f.*").first()
    assert tuple(got)[:5] == rows[0] and got.body == "body\n" and got.problem is None
    bad = ["no block", "---\ntitle: a\n---\n", "---\ntitle: a\nauthor: b\nsource_url: c\ncaptured: d\npublished: e\n---\n"]
    assert [r[0] for r in values(spark, "m string", [(b,) for b in bad], text.strict_front_matter(F.col("m"))["problem"])] == ["missing", "field count", "field 4"]


def test_first_heading_is_removed_only_if_it_is_the_title(spark):
    rows = [("# The *Title* #\n\ntext", "The Title"), ("# Other\ntext\n# The Title", "The Title"), ("```\n# The Title\n```\n# The Title\nx", "The Title"), ("~~~~\n~~~\n# T\n~~~~\ny", "T"), ("# T\nx", "")]
    got = [r[0] for r in values(spark, "m string, t string", rows, text.remove_first_heading(F.col("m"), F.col("t")))]
    assert got == ["text", rows[1][0], "```\n# The Title\n```\nx", rows[3][0], rows[4][0]]


def test_style_and_blocks(spark):
    body = "## Core *Concepts*\n```\nthe speaker then says\n```\nThe speaker then says x\nhttps://h/in-the-video fine\n老师随后强调"
    assert values(spark, "b string", [(body,)], text.style_violations(F.col("b"))) == [([1, 5, 7],)]
    note = "---\na: b\n---\n\n# H\n\n```py\nx\n```\n\n![i](<a b.png>)\n\n> q\n\n- l\n\n1. l\n\n| a |\n\n---\n\ntext [l](u) ![i](p \"t\")"
    got = values(spark, "b string", [(note,)], text.block_types(F.col("b")), text.image_destinations(F.col("b")), text.link_destinations(F.col("b")), text.code_blocks(F.col("b")))
    assert got[0][:3] == (["H1", "CODE", "IMAGE", "QUOTE", "LIST", "LIST", "TABLE", "RULE", "PARAGRAPH"], ["a b.png", "p"], ["u"])
    assert [tuple(c) for c in got[0][3]] == [("py", "x")]
    alts = ["Screenshot 00:10", "slide frame", "幻灯片", "A loss curve", "screenshot of x"]
    assert [r[0] for r in values(spark, "a string", [(a,) for a in alts], text.is_generic_alt(F.col("a")))] == [True, True, True, False, False]


def test_image_signatures(spark):
    rows = [(b"\xff\xd8\xff\xe0", None), (b"<svg xmlns='x'></svg>", None), (b"<?xml version='1.0'?>\n<svg><script>1</script></svg>", None), (b"\x89PNG\r\n\x1a\n", "text/html"), (b"hello", "image/png"), (b"<svg><image href='https://x/'/></svg>", "image/svg+xml; charset=utf-8")]
    assert [r[0] for r in values(spark, "c binary, t string", rows, images.sniff(F.col("c"), F.col("t")))] == ["image/jpeg", "image/svg+xml", None, None, None, None]
