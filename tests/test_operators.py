import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import frames, graph, identity, notes, rules, segment, similarity
from factloom.sources import files, html, records, vtt
from factloom.sources.markdown import discover, front_matter, read


def test_blocks_follow_commonmark():
    body = "# A #\npara\nlazy\n---\n- x\n  y\n\n  z\n- w\nlazy\n\n1. n\n> q\nlazy\n\n    code\n\n```py\n# no\n```\n<div>\nh\n\n***\nTitle\n=\n"
    got = [(k, v, s, e) for k, v, s, e, _ in segment.blocks(body)]
    assert got == [
        ("heading", 1, 0, 1), ("heading", 2, 1, 4), ("list", 0, 4, 10), ("list", 0, 11, 12), ("quote", 0, 12, 14), ("code", 0, 15, 16), ("fence", 0, 17, 20), ("html", 0, 20, 22), ("heading", 1, 24, 26)]


def test_units_inherit_timestamps_and_merge_within_bounds():
    body = "# [https://v.example/?t=42](https://v.example/?t=42) Concept\n\nA fact.\n\nAnother.\n### Deep\nx\n### Deeper\ny\n## Two\nz\n" + "\n\n".join(["w" * 2500] * 4)
    got = segment.units(body, 5)
    assert got[0][0] == ["https://v.example/?t=42 Concept"] and got[0][1:3] == (7, 9) and got[0][4] == ["https://v.example/?t=42"]
    paths = [u[0][1:] for u in got]
    assert paths[1:4] == [["Deep"], ["Deep", "Deeper"], ["Two"]], "a skipped level nests by position"
    assert all(len(u[3]) <= 6000 for u in got) and sum(u[3].count("w") for u in got) == 10_000


def test_spans_are_exact_and_exhaustive(spark):
    content = "First fact. Second fact!  \n\n  - item one. item two\n12) numbered\n| a | b |\n![i](x)\n[l](u)\n    code line\n中文一。中文二！end\r\nlast"
    units = spark.createDataFrame([("eu_1", content, 10)], "evidence_unit_id string, content string, start_line int")
    rows = segment.evidence_spans(units).orderBy("start_offset").collect()
    assert [r.content for r in rows] == ["First fact.", "Second fact!", "item one.", "item two", "numbered", "| a | b |", "![i](x)", "[l](u)", "code line", "中文一。", "中文二！", "end", "last"]
    assert all(content[r.start_offset : r.end_offset] == r.content for r in rows)
    assert [r.span_kind for r in rows] == ["prose"] * 2 + ["list-item"] * 3 + ["table-row", "media", "link", "code"] + ["prose"] * 4
    assert [r.start_line for r in rows] == [10, 10, 12, 12, 13, 14, 15, 16, 17, 18, 18, 18, 19]
    assert rules.is_open(rules.span_rules(segment.evidence_spans(units), units))


def test_front_matter_reader(spark):
    texts = ["---\ntitle: x\nn: [1]\n---\nbody\nmore", "no block", "---\nopen", "---\n- a\n---\n", "---\na: [\n---\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(front_matter("t").alias("f")).select("f.*").collect()
    assert tuple(got[0]) == ('{"title": "x", "n": [1]}', "body\nmore", 5, None) and tuple(got[1]) == ("{}", "no block", 1, None)
    assert [r.problem for r in got[2:5]] == ["unclosed", "not a mapping", "invalid"] and got[5].body == ""


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b)), lambda best, j, r=row, x=x: max(best, r[j + 1], r[j] + (x == b[j])), initial=0))
    return row[-1]


def test_string_scores():
    a, b = "system x enables caching.", "system x does not enable caching."
    assert round(similarity.ratio(a, b) / 100, 4) == 0.8276
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = ("".join("abcd"[i] for i in rng.integers(0, 4, int(rng.integers(0, 80)))) for _ in "xy")
        assert similarity.lcs(x, y) == plain_lcs(x, y)
    assert similarity.ratio("", "") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert similarity.token_set_ratio("a b", "A B") == similarity.ratio("a b", "A B")


def claims(spark, rows):
    full = [(f"ec_{i}", f"eu_{u}", s, p, m, t, subj, pred, None, sc, c) for i, (u, s, p, m, t, subj, pred, sc, c) in enumerate(rows)]
    return spark.createDataFrame(full, "evidence_claim_id string, evidence_unit_id string, statement string, polarity string, modality string, claim_type string, subject string, predicate string, time string, scope string, conditions array<string>")


def test_alignment_relations(spark):
    base = ("System X enables caching.", "positive", "asserted", "fact", "System X", "enables", "en", [])
    rows = [(1, *base), (2, *base), (2, *base), (3, "System X does not enable caching.", "negative", "asserted", "fact", "System X", "enables", "en", []), (4, "System X enables caching.", "positive", "asserted", "fact", "Other thing", "enables", "en", []), (5, "Nothing shared qqqq zzzz", "positive", "asserted", "fact", "System X", "enables", "en", [])]
    got = {(r.left_claim_id[-1], r.right_claim_id[-1]): r for r in similarity.suggest(claims(spark, rows)).collect()}
    assert got["0", "1"].candidate_relation == "possibly-equivalent" and got["0", "3"].candidate_relation == "possibly-conflicting"
    assert got["0", "4"].decision_reasons == ["entity-incompatible"] and got["0", "4"].policy_decision == "keep-separate"
    assert ("1", "2") not in got and not any("5" in k for k in got)
    assert similarity.comparisons(claims(spark, rows)).first()[0] == 14
    with pytest.raises(ValueError, match="LIMIT"):
        similarity.suggest(claims(spark, rows), most=2)
    with pytest.raises(ValueError, match="PARAMETER"):
        similarity.suggest(claims(spark, rows), 1.5)


def test_alignment_filter_loses_nothing(spark):
    rng = np.random.default_rng(3)
    words = ["a", "bb", "ccc", "dddd", "eeeee", "f"]
    rows = [(i, " ".join(words[j] for j in rng.integers(0, 6, int(rng.integers(1, 9)))), "positive", "asserted", "fact", "s", "p", None, []) for i in range(40)]
    df = claims(spark, rows)
    for threshold in (0.3, 0.55, 0.9):
        got = {(r.left_claim_id, r.right_claim_id) for r in similarity.signals(df, threshold).collect()}
        ids = sorted(range(40), key=lambda i: f"ec_{i}")
        want = {(f"ec_{a}", f"ec_{b}") for x, a in enumerate(ids) for b in ids[x + 1 :] if max(similarity.ratio(rows[a][1], rows[b][1]), similarity.token_set_ratio(rows[a][1], rows[b][1])) / 100 >= threshold}
        assert got == want


def test_course_parts_share_corpus_not_work(spark):
    rows = [("s1", "p1", "https://y/1", "course-note", "X | Part 1", "Ann"), ("s2", "p2", "https://y/2", "course-note", "X | part 2", "ANN"), ("s3", "p3", None, "user-note", "X", None)]
    df = spark.createDataFrame(rows, "source_id string, path string, source_url string, source_kind string, title string, author string")
    for c in ("publisher", "corpus", "independence_group"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    a, b, c = identity.identities(df).orderBy("source_id").collect()
    assert a.work_id != b.work_id and (a.corpus_id, a.publisher_id, a.independence_group_id) == (b.corpus_id, b.publisher_id, b.independence_group_id) != (c.corpus_id, c.publisher_id, c.independence_group_id)


NOTE = "---\ntitle: T\nauthor: A\nsource_url: https://h/\npublished: \ncaptured: 2024-01-01T00:00:00\n---\n"


def test_translation_checks(spark):
    body = "# Head\n\nSome English text of a reasonable length.\n\n![i](<a.png>)\n\n## Two\n\n[l](https://h/x)\n\n```py\nx = 1\n```\n"
    good = "# 标题\n\n这是一个完整的中文翻译，长度也合理。\n\n![图](<a.png>)\n\n## 二\n\n[链](https://h/x)\n\n```py\nx = 1\n```\n"
    cases = {"passed": NOTE + good, "empty": "  ", "metadata": NOTE.replace("T\n", "U\n") + good, "code": NOTE + good.replace("x = 1", "x = 2"), "images": NOTE + good.replace("a.png", "b.png"), "links": NOTE + good.replace("h/x", "h/y"), "block-structure": NOTE + good.replace("## 二\n\n", ""), "length-ratio": NOTE + good.replace("这是一个完整的中文翻译，长度也合理。", "短" * 300), "no-chinese": NOTE + body}
    df = spark.createDataFrame([(k, NOTE + body, v) for k, v in cases.items()], "want string, o string, t string")
    assert all(r.want == r.check for r in identity.translation_check(df, "o", "t").collect())
    pairs = identity.translation_pairs(spark.createDataFrame([("d/a.md",), ("d/a（中文翻译）.md",), ("e/a（中文翻译）.md",)], "path string")).orderBy("path").collect()
    assert [(r.path, r.original_path) for r in pairs] == [("d/a（中文翻译）.md", "d/a.md"), ("e/a（中文翻译）.md", None)]


def test_captions(spark):
    good = "﻿WEBVTT\r\n\r\n1\r\n00:00.000 --> 00:05.000 align:start\r\n<c>Hello</c>&nbsp; there\r\nyou\r\n\r\n00:00:05.000 --> 00:00:10,000\r\n \r\n\r\n01:00:00.000 --> 01:00:01.500\r\nend\r\n"
    files = [("a", good), ("b", "no"), ("c", "WEBVTT\n\n00:05.000 --> 00:01.000\nx\n"), ("d", "WEBVTT\n\n00:01.000 --> 00:02.000\n\n"), ("e", None)]
    got = vtt.parse(spark.createDataFrame(files, "id string, v string"), "id", "v").collect()
    cues = sorted((r.start, r.end, r.text) for r in got if r.problem is None)
    assert cues == [(0.0, 5.0, "Hello there you"), (3600.0, 3601.5, "end")]
    assert sorted((r.id, r.problem) for r in got if r.problem) == [("b", "not WEBVTT"), ("c", "timing"), ("d", "no cues"), ("e", "not WEBVTT")]
    rows = [("k", 0, 0.0, 1.25, " a  b "), ("k", 1, 1.0, 2.0, " "), ("k", 2, 3661.5, 3662.0, "x --> y")]
    out = vtt.render(spark.createDataFrame(rows, "k string, n int, s double, e double, t string"), "k", "n", "s", "e", "t").first().vtt
    assert out == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.250\na b\n\n3\n01:01:01.500 --> 01:01:02.000\nx → y\n"


def test_generic_article():
    page = """<html><head><title>Page</title><meta name="author" content="M"><meta name="description" content="A standfirst."><meta property="og:image" content="/cover.png">
    <script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["BlogPosting"], "author": [{"name": "Ann"}, "Bob"], "datePublished": "2024-02-03", "headline": "H"}]}</script></head>
    <body><nav>menu</nav><main><article><p>Intro with <b>bold</b>, <em>it</em>, <a href="/x">link</a> and <code>c`d</code>.<p>Second<br>line
    <h2><b>Sec</b>tion</h2><ul><li>one<ul><li>nested</ul><li>two</ul><ol start="3"><li>three</ol><blockquote><p>quote</p></blockquote>
    <pre><code class="language-py">x = 1
y</code></pre><table><tr><td>a|b<td>c<tr><td>d</table><figure><img src="f.png" alt="F"><figcaption>cap</figcaption></figure><hr><aside>aside text</aside><button>no</button><script>no()</script></article></main></body></html>"""
    title, author, published, description, text, n, tag, points, images = html.article(page, "https://h.example/p/", "generic-article")
    assert (title, author, published, description) == ("H", "Ann, Bob", "2024-02-03", "A standfirst.") and tag == "article" and points > 100_000
    want = ["# H", "A standfirst.", "{{KNOWLEDGE_IMAGE_001}}", "Intro with **bold**, *it*, [link](https://h.example/x) and `c\\\\`d`.", "Second\nline", "## **Sec**tion", "- one\n  - nested\n- two", "3. three", "> quote", "```py\nx = 1\ny\n```", "|  |  |\n| --- | --- |\n| a\\|b | c |\n| d |  |", "{{KNOWLEDGE_IMAGE_000}}", "*cap*", "---", "aside text"]
    for part in want[3:]:
        assert part in text or part.replace("\\\\`", "\\`") in text or part.replace("\\\\", "\\\\\\") in text, (part, text)
    assert text.startswith("# H\n\nA standfirst.") and [i[1] for i in images] == ["https://h.example/p/f.png", "https://h.example/cover.png"]
    assert "menu" not in text and "no()" not in text and html.article("<p>x</p>", None, "generic-article") is None and html.article(None, None, "x-article") is None


def test_x_article_and_rich_text():
    page = '<main><article>noise ' + "n " * 400 + '</article><div data-testid="twitterArticleReadView"><h1>Title</h1><h2><b>Bold</b></h2><p>Body</p><img src="https://pbs.twimg.com/media/a?format=jpg&name=small"><img src="https://pbs.twimg.com/media/a?format=jpg&name=large"><img src="https://pbs.twimg.com/profile_images/p.png"><div data-testid="like">9</div></div></main>'
    title, *_, text, n, tag, points, images = html.article(page, "https://x.com/a", "x-article")
    assert title == "Title" and "## Bold" in text and "noise" not in text and points > 100_000 and "9" not in text
    assert [i[1] for i in images] == ["https://pbs.twimg.com/media/a?format=jpg&name=orig"]
    page = '<div class="blog-post-content"><div class="w-richtext x"><p>Post text</p></div></div><footer>noise</footer>'
    assert html.article(page, "https://langchain.com/b", "langchain-blog")[4] == "Post text"


def frame(width, height, draw):
    a = np.full((height, width, 3), 255, np.uint8)
    draw(a)
    return a.tobytes()


def test_slide_bounds():
    def box(a):
        a[300:700, 600:1300] = 20

    assert frames.slide_bounds(frame(1920, 1080, box), 1920, 1080) is None, "a box within a page is content"

    def page(a):
        inner = a[88:1080, 78:1842].copy()
        a[:] = 0
        a[88:1080, 78:1842] = inner

    found = frames.slide_bounds(frame(1920, 1080, page), 1920, 1080)
    assert found and abs(found[3] - 78) <= 4 and abs(found[4] - 88) <= 4 and abs(found[2] - 1764) <= 4 and abs(found[1] - 992) <= 4


def test_stable_segments_of_frames(spark):
    w, h = 160, 90
    shades = [255] * 6 + [0] * 6 + [128] + [255] * 6
    rows = [("v", i / 2, bytes([s]) * (w * h * 3)) for i, s in enumerate(shades)]
    df = spark.createDataFrame(rows, "video string, at double, rgb binary").withColumn("f", frames.describe(w, h)("rgb"))
    df = df.select("video", "at", F.col("f.signature").alias("signature"), F.col("f.quality.score").alias("score"))
    runs = frames.frame_runs(df, "video", "at", "signature", frames.byte_difference)
    got = frames.representatives(runs, "video", "at", "score").where("place = 1").orderBy("segment").collect()
    assert [(r.segment, r.sample_count, r.start_seconds, r.end_seconds) for r in got] == [(1, 6, 0.0, 2.5), (2, 6, 3.0, 5.5), (3, 6, 6.5, 9.0)]
    assert len(df.first().signature) == 80 * 45


def capture(name, at, score, deficit=0.0, cropped=False, tokens=(), shade=10, dhash="0" * 16):
    return {"name": name, "at": at, "score": score, "deficit": deficit, "cropped": cropped, "tokens": list(tokens), "signature": bytes([shade]) * 5184, "dhash": dhash}


def test_greedy_collapse():
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    a, b = capture("a", 0, 5), capture("b", 10, 6)
    assert [(k["name"], k["alternates"]) for k in frames.collapse_one([a, b])] == [("b", ["a"])]
    far = capture("far", 80, 9)
    assert [k["name"] for k in frames.collapse_one([a, far])] == ["a", "far"]
    other = capture("o", 5, 5, shade=200, dhash="f" * 16)
    assert [k["name"] for k in frames.collapse_one([a, other, b])] == ["a", "o", "b"], "an exact repeat counts only next to it"
    clear = [capture("dark", 0, 9, deficit=0.2, tokens=words), capture("x", 5, 5, shade=200, dhash="f" * 16), capture("clear", 10, 3, deficit=0.0, tokens=words, shade=90, dhash="0f" * 8)]
    assert [(k["name"], k["alternates"]) for k in frames.collapse_one(clear)] == [("x", []), ("clear", ["dark"])]


def test_graphs(spark):
    e = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    assert graph.is_acyclic(e([("a", "b"), ("b", "c"), ("a", "c")])) and graph.is_acyclic(e([]))
    assert {tuple(r) for r in graph.cycle_edges(e([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])).collect()} == {("b", "c"), ("c", "b")}
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    assert graph.is_acyclic(e(chain)) and not graph.is_acyclic(e(chain + [("n060", "n000")]))


def test_strict_records(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()), False)])
    lines = ['{"id": "a", "n": 1, "tags": []}', "", '{"id": "b", "n": "1", "tags": []}', '{"id": "c", "tags": ["x"], "extra": 1}', '{"id": 5, "tags": []}', "{bad", '{"n": 2, "tags": []}', '{"id": "z", "n": null, "tags": ["q"]}', "[1]"]
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join(lines))
    good, bad = records.read_jsonl(spark, str(p), schema)
    assert sorted(r.id for r in good.collect()) == ["a", "z"]
    assert sorted((r.record_id, r.detail) for r in bad.collect()) == [("3", "type of n"), ("4", "unknown field extra"), ("5", "type of id"), ("6", "invalid JSON"), ("7", "missing field id"), ("9", "not an object")]


def test_a_dead_publisher_is_taken_over_and_fenced(spark, tmp_path):
    target, one = str(tmp_path / "kb"), spark.createDataFrame([(1, "a")], "id long, t string")
    slow = records.Publication(spark, target, lease_seconds=0.0)

    def taken_over(read):  # while the first verifies, its lease runs out and a second one publishes
        assert records.Publication(spark, target, lease_seconds=0.0).publish({"claims": one}, "second")["status"] == "published"

    with pytest.raises(ValueError, match="FENCED"):
        slow.publish({"claims": one.union(one)}, "first", taken_over)
    state = slow.current()
    assert state["fingerprint"] == "second" and slow.read("claims").count() == 1 and slow.drifted().collect() == []
    assert [p.name for p in (tmp_path / "kb" / "builds").iterdir()] == [state["build_id"]]
    dead = files.Lease(spark, f"{target}/publish.lock", 100.0)
    assert dead.take()
    with pytest.raises(ValueError, match="LOCKED"):
        records.Publication(spark, target, lease_seconds=100.0).publish({"claims": one}, "third")
    assert records.Publication(spark, target, lease_seconds=0.0).publish({"claims": one}, "third")["status"] == "published"
    with pytest.raises(ValueError, match="FENCED"):
        dead.beat()


def test_publication(spark, tmp_path):
    pub = records.Publication(spark, str(tmp_path / "kb"))
    one = spark.createDataFrame([(1, "a")], "id long, t string")
    first = pub.publish({"claims": one}, "f1")
    assert first["status"] == "published" and pub.publish({"claims": one}, "f1")["status"] == "noop"
    assert pub.read("claims").collect() == one.collect() and pub.drifted().collect() == []

    def refuse(read):
        raise ValueError("gate")

    with pytest.raises(ValueError, match="gate"):
        pub.publish({"claims": one.union(one)}, "f2", refuse)
    assert pub.current()["build_id"] == first["build_id"] and pub.read("claims").count() == 1
    other = files.Lease(spark, str(tmp_path / "kb" / "publish.lock"))
    assert other.take() and not files.Lease(spark, str(tmp_path / "kb" / "publish.lock")).take()
    with pytest.raises(ValueError, match="LOCKED"):
        pub.publish({"claims": one}, "f3")
    other.release()
    part = next((tmp_path / "kb" / "builds" / first["build_id"] / "claims").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    part.with_name(f".{part.name}.crc").unlink()
    assert [r.drift for r in pub.drifted().collect()] == ["changed"]


def test_discovery(spark, tmp_path):
    vault = tmp_path / "v"
    (vault / "notes").mkdir(parents=True)
    (vault / "kb").mkdir()
    for name in ("notes/a.md", "notes/B.MD", "notes/c.txt", "kb/d.md"):
        (vault / name).write_text("# " + name)
    found = discover(str(vault), str(vault / "kb"), [str(vault / "notes"), str(vault / "notes" / "a.md")])
    assert [p.rsplit("/", 1)[1] for p in found] == ["B.MD", "a.md"]
    rows = read(spark, found, str(vault)).orderBy("path").collect()
    assert [(r.path, r.markdown, r.byte_size) for r in rows] == [("notes/B.MD", "# notes/B.MD", 12), ("notes/a.md", "# notes/a.md", 12)]
    for bad, code in ((["notes"], "NOT_ABSOLUTE"), ([str(tmp_path)], "OUTSIDE"), ([str(vault / "kb")], "OVERLAP"), ([str(vault / "none")], "MISSING")):
        with pytest.raises(ValueError, match=code):
            discover(str(vault), str(vault / "kb"), bad)
    (vault / "notes" / "l.md").symlink_to(vault / "notes" / "a.md")
    with pytest.raises(ValueError, match="UNSAFE"):
        discover(str(vault), str(vault / "kb"), [str(vault / "notes")])


def test_article_notes(spark):
    ok = NOTE + "text ![a](<Knowledge Assets/x/01-a.png>)"
    rows = [("ok", ok), ("remote", NOTE + "![a](https://h/i.png)"), ("token", NOTE + "{{KNOWLEDGE_IMAGE_000}}"), ("empty", NOTE + " \n"), ("place", NOTE + "![a](other/x.png)"), ("front", "text"), ("date", NOTE.replace("published: ", "published: 2024") + "t")]
    assets = spark.createDataFrame([("Knowledge Assets/x/01-a.png", "image/png")], "path string, mime string")
    got = sorted((r.record_id, r.rule_code) for r in notes.article_rules(spark.createDataFrame(rows, "path string, markdown string"), assets).collect())
    assert got == [("date", "NOTE_PUBLISHED"), ("empty", "NOTE_EMPTY"), ("front", "NOTE_FRONT_MATTER"), ("place", "NOTE_IMAGE_MISSING"), ("place", "NOTE_IMAGE_PLACE"), ("remote", "NOTE_IMAGE_MISSING"), ("remote", "NOTE_IMAGE_PLACE"), ("remote", "NOTE_REMOTE_IMAGE"), ("token", "NOTE_PLACEHOLDER")]
