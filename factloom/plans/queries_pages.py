"""Queries over pages, plans, slides' geometry, arrays and resumable work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text
from factloom.functions.udf import arrow_udf
from factloom.operators import frames, graph, incremental, notes, pages, rules, segment, support
from factloom.plans import derive
from factloom.plans.derive import CANONICAL_SQL, SOURCES_SQL, SPANS_SQL
from factloom.plans.registry import registry
from factloom.session import spread, stored, table
from factloom.sources import html

QUERIES, SQL, query = registry()

_WORDS = "'Text ' || trim(regexp_replace(text, '[^A-Za-zÀ-ÿ]+', ' '))"
_WORDS_SQL = _WORDS.replace("' '))", "' ', 'g'))")


def _page(with_citation=True):
    """A page of a conversation's turn: main text, open questions, evidence."""
    cited = "CASE WHEN turn % 2 = 0 THEN ' [^cc_' || conv_id || '_' || turn || ']' ELSE '' END"
    return F.expr(
        "'## Core' || char(10) || char(10) || " + _WORDS + f" || {cited} || char(10) || char(10) || '- listed fact' || {cited} || char(10) || char(10) || '[note] aside' || char(10) || char(10) || '## 开放问题' || char(10) || char(10) || 'open' || char(10) || char(10) || '## Evidence' || char(10) || char(10) || '[^cc_' || conv_id || '_' || turn || ']: from here' || char(10)"
    )


@query(f"""SELECT conv_id, turn, '1:' || {_WORDS_SQL} || CASE WHEN turn % 2 = 0 THEN ' [^cc_' || conv_id || '_' || turn || ']' ELSE '' END AS blocks, CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END AS uncited FROM conversations""")
def p_factual_blocks(spark, d):
    p = table(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("page"), _page().alias("body"))
    blocks = segment.factual_blocks(p, "page", "body")
    first = blocks.groupBy("page_id").agg(F.min_by(F.concat_ws(":", "ordinal", "text"), "ordinal").alias("blocks"), F.count_if(~F.col("text").rlike(text.CITATION)).cast("int").alias("uncited"))
    return first.select("page_id.conv_id", "page_id.turn", "blocks", "uncited")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'cc_' || conv_id || '_' || turn || ',cc_' || conv_id || '_' || turn ELSE '' END AS cited, 'cc_' || conv_id || '_' || turn AS defined, true AS has_sections, '[^cc_' || conv_id || '_' || turn || ']: from here' AS evidence FROM conversations""")
def p_page_citations(spark, d):
    p = table(spark, d, "conversations").select("conv_id", "turn", _page().alias("body"))
    main, evidence = text.evidence_parts(F.col("body"))
    headings = F.regexp_extract_all("body", F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$"), F.lit(1))
    need = F.array(F.lit("Core"), F.lit("开放问题"), F.lit("Evidence"))
    return p.select("conv_id", "turn", F.array_join(text.citations(main), ",").alias("cited"), F.array_join(text.definitions(evidence), ",").alias("defined"), (F.size(F.array_except(need, headings)) == 0).alias("has_sections"), F.trim(F.regexp_replace(evidence, r"^\s+|\s+$", "")).alias("evidence"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN '../x.md' WHEN p_partkey % 40 = 1 THEN 'same.md' ELSE 'p/' || p_partkey || '.md' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'concept' ELSE 'comparison' END AS kind, p_partkey % 7 AS n FROM part)
SELECT 'DUPLICATE_PAGE_PATH' AS rule_code, path AS record_id, CAST(count(*) AS VARCHAR) AS detail FROM p GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'INVALID_PAGE_PATH', CAST(k AS VARCHAR), path FROM p WHERE path = '../x.md' UNION ALL SELECT 'MISSING_INDEX', 'index.md', NULL
UNION ALL SELECT 'PAGE_PLAN_DRIFT', path, 'left only' FROM (SELECT DISTINCT path FROM p WHERE k % 9 = 0 AND path NOT IN (SELECT path FROM p WHERE k % 9 <> 0))
UNION ALL SELECT 'INVALID_CONCEPT_PAGE', CAST(k AS VARCHAR), NULL FROM p WHERE kind = 'concept' AND (n = 3 OR n = 4) UNION ALL SELECT 'INVALID_COMPARISON_PAGE', CAST(k AS VARCHAR), NULL FROM p WHERE kind = 'comparison' AND n <> 3
UNION ALL SELECT 'INDEX_COVERAGE', CAST(k AS VARCHAR), path FROM p WHERE path <> 'same.md' AND path <> '../x.md'""")
def p_page_plan(spark, d):
    k = F.col("p_partkey")
    n, cc = k % 7, F.concat(F.lit("cc_"), k)
    path = F.when(k % 50 == 0, "../x.md").when(k % 40 == 1, "same.md").otherwise(F.concat(F.lit("p/"), k, F.lit(".md")))
    p = table(spark, d, "part").select(
        k.alias("page_id"), k, F.when(k % 2 == 0, "concept").otherwise("comparison").alias("page_type"), path.alias("path"), F.array(cc).alias("claim_ids"),
        F.when(n == 3, F.array(F.concat(F.lit("c"), k), F.lit("c0"))).otherwise(F.array(F.concat(F.lit("c"), k))).alias("concept_ids"),
    )
    concepts = p.select(F.concat(F.lit("c"), k).alias("concept_id"), F.when(n == 4, F.array(F.lit("cc_other"))).otherwise(F.array(cc)).alias("claim_ids"))
    index = spark.createDataFrame([("see same.md and ../x.md",)], "text string")
    return support.page_plan_rules(p, p.where(k % 9 != 0).select("path"), concepts, index)


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN 'x' || o_orderkey || '.png' ELSE printf('%03d-00h%02dm%02ds.jpg', o_orderkey, o_orderkey % 60, o_orderkey % 50) END AS name, o_orderkey % 30 = 7 AS gone FROM orders)
SELECT 'CANDIDATE_NAME' AS rule_code, name AS record_id, CAST(NULL AS VARCHAR) AS detail FROM c WHERE k % 20 = 0 UNION ALL SELECT 'CANDIDATE_IMAGE', name, NULL FROM c WHERE gone
UNION ALL SELECT 'CANDIDATE_COUNT', 'all', CAST(count(*) AS VARCHAR) FROM c HAVING count(*) > 1000""")
def p_candidates(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 20 == 0, F.concat(F.lit("x"), k, F.lit(".png"))).otherwise(F.format_string("%03d-00h%02dm%02ds.jpg", k, k % 60, k % 50))
    c = table(spark, d, "orders").select(name.alias("name"), F.when(k % 30 != 7, "image/jpeg").alias("mime"))
    return notes.candidate_rules(c, c.count())


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) // 2 * 2 AS x, CAST(l_suppkey % 40 AS INTEGER) // 2 * 2 AS y,
 least((100 // 2) * 2, ((CAST(l_quantity AS INTEGER) + 61) // 2) * 2) - CAST(l_quantity AS INTEGER) // 2 * 2 AS width, least((80 // 2) * 2, ((CAST(l_suppkey % 40 AS INTEGER) + 51) // 2) * 2) - CAST(l_suppkey % 40 AS INTEGER) // 2 * 2 AS height FROM lineitem""")
def s_crop_box(spark, d):
    b = F.struct(F.col("l_quantity").cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), F.lit(60).alias("width"), F.lit(50).alias("height"))
    box = frames.crop_box(b, F.lit(1.0), F.lit(1.0), F.lit(100), F.lit(80))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.width", "b.height")


@query("""SELECT vec_id, CAST(floor(abs(embedding[1]) * 40) AS INTEGER) % 40 + 6 AS x, CAST(floor(abs(embedding[2]) * 20) AS INTEGER) % 20 + 4 AS y, 256 AS width, 144 AS height, true AS sure FROM embeddings""")
def s_slide_bounds(spark, d):
    """Each vector as a drawn page: its first values place a bright page on a dark frame."""
    def draw(v):
        x, y = int(abs(v[0]) * 40) % 40, int(abs(v[1]) * 20) % 20
        a = np.zeros((180, 320, 3), np.uint8)
        a[y + 4 : y + 148, x + 6 : x + 262] = 230
        return a.tobytes()

    got = spread(table(spark, d, "embeddings")).select("vec_id", frames.bounds_of(320, 180, draw)("embedding").alias("b"))
    return got.select("vec_id", "b.x", "b.y", "b.width", "b.height", (F.col("b.confidence") > 0.9).alias("sure"))


@query("SELECT s.doc_id FROM documents s WHERE NOT (s.doc_id % 3 = 0 AND s.lang = 'en' AND length(s.source) % 2 = 0)")
def i_unfinished(spark, d):
    docs = table(spark, d, "documents")
    done = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("segment_id"), F.when(F.col("lang") == "en", "h1").otherwise("h0").alias("source_sha256"), (F.length("source") % 2).alias("version"))
    return incremental.unfinished(docs.withColumn("segment_id", F.col("doc_id")), done, "h1", 0).select("doc_id")


@query(f"""WITH {SOURCES_SQL}, r AS (SELECT source_id || chr(31) || path AS k, sha256(CAST(to_json({{'content_sha256': content_sha256, 'path': path, 'source_id': source_id}}) AS VARCHAR)) AS d FROM src),
b AS (SELECT substr(sha256(k), 1, 3) AS bucket, sha256(string_agg(k || '=' || d, chr(10) ORDER BY k || '=' || d)) AS d FROM r GROUP BY 1)
SELECT sha256('{{"profile":"default","sources":"' || sha256(string_agg(d, chr(10) ORDER BY bucket)) || '","version":1}}') AS build_fingerprint FROM b""")
def i_build_fingerprint(spark, d):
    mark = incremental.build_fingerprint(derive.sources(spark, d), version=1, profile="default")
    return spark.createDataFrame([(mark,)], "build_fingerprint string")


@query("""WITH a AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS x, list(o_orderstatus ORDER BY o_orderkey) AS y FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '|') AS ordered_distinct, len(list_distinct(y)) = len(y) AS unique_items, len(list_intersect(x, ['1-URGENT', '2-HIGH'])) AS shared, list_contains(y, 'F') AND list_contains(y, 'O') AND NOT list_contains(y, 'P') AS exact FROM a""")
def u_arrays(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("s"))
    x, y = F.transform("s", lambda r: r["o_orderpriority"]), F.transform("s", lambda r: r["o_orderstatus"])
    keys = F.map_from_entries(F.transform(F.array_distinct(y), lambda v: F.struct(v, F.lit(1))))
    return o.select("o_custkey", F.array_join(F.array_distinct(x), "|").alias("ordered_distinct"), rules.unique_items(y).alias("unique_items"), F.size(F.array_intersect(x, F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).cast("long").alias("shared"), rules.exact_keys(keys, "O", "F").alias("exact"))


@query("""WITH u AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier) SELECT 'DUPLICATE_ID' AS rule_code, CAST(id AS VARCHAR) AS record_id, CAST(count(*) AS VARCHAR) AS detail FROM u GROUP BY id HAVING count(*) > 1""")
def u_union_collisions(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return incremental.merge(a, b, "id")[1]


@query(r"""SELECT p_partkey, CAST(least(length(trim(p_name)), 300) + CASE WHEN p_size % 5 = 0 THEN 600 ELSE 0 END + CASE p_partkey % 3 WHEN 0 THEN 700 WHEN 1 THEN 250 ELSE 0 END - CASE WHEN length(trim(p_name)) < 20 THEN 800 ELSE 0 END AS INTEGER) AS score FROM part""")
def m_card_score(spark, d):
    k = F.col("p_partkey")
    href = F.when(k % 3 == 0, "https://x.com/i/article/5").when(k % 3 == 1, "https://x.com/a/status/5").otherwise("https://x.com/a")
    return table(spark, d, "part").select("p_partkey", html.card_score(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, 1).otherwise(0), href).alias("score"))


@query("""SELECT doc_id, '![a \\[' || lang || '\\]](<i.png>)' AS image, 'Title of ' || source AS heading FROM documents""".replace("\\\\", "\\"))
def f_alt_and_heading(spark, d):
    from factloom.sources.images import markdown_image

    alt = F.concat(F.lit("a ["), "lang", F.lit("]"))
    raw = F.concat(F.lit("**Title**  of ["), "source", F.lit("](https://t.example/)"))
    return table(spark, d, "documents").select("doc_id", markdown_image(alt, F.lit("i.png")).alias("image"), text.heading_text(raw).alias("heading"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Note ' || doc_id ELSE lang || '-' || doc_id END AS title FROM documents")
def f_source_title(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Note "), "doc_id"))
    return table(spark, d, "documents").select("doc_id", text.source_title(title, F.concat_ws("-", "lang", F.concat("doc_id", F.lit(text.TRANSLATION_SUFFIX)))).alias("title"))


@query("""SELECT 'UNREFERENCED' AS rule_code, CAST(p.p_partkey AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS detail FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def j_published_assets(spark, d):
    return rules.missing(table(spark, d, "part"), "p_partkey", table(spark, d, "lineitem").where("l_quantity = 50"), "l_partkey", "UNREFERENCED")


@query("""WITH r AS (SELECT c_custkey AS k FROM customer), g AS (
SELECT 'citation_closure' AS gate FROM r WHERE k % 3 = 0 UNION ALL SELECT 'published_claim_evidence_rate' FROM r WHERE k % 5 = 0 UNION ALL SELECT 'span_processing_rate' FROM r WHERE k % 7 = 0
UNION ALL SELECT 'conflict_visibility_rate' FROM r WHERE k % 11 = 0 UNION ALL SELECT 'probe-failures' FROM r WHERE k % 4 > 0 UNION ALL SELECT 'entailment-review' FROM r WHERE k % 6 = 1) SELECT gate, count(*) AS n FROM g GROUP BY gate""")
def a_gate_failures(spark, d):
    k = F.col("c_custkey")
    rate = lambda n, bad: F.when(k % n == 0, bad).otherwise(1.0)
    rows = table(spark, d, "customer").select(
        rate(3, 0.5).alias("citation_closure"), rate(5, 0.0).alias("published_claim_evidence_rate"), rate(7, F.lit(None).cast("double")).alias("span_processing_rate"), rate(11, 0.9).alias("conflict_visibility_rate"),
        (k % 4).alias("probe_failures"), F.when(k % 6 == 1, 2).otherwise(0).alias("entailment_open"),
    )
    return support.gate_failures(rows).groupBy("gate").agg(F.count("*").alias("n"))


@query(f"""WITH {SPANS_SQL} SELECT 'INVALID_IR' AS rule_code, 'es_' || substr(sha256(doc_id || '-' || start_offset), 1, 20) AS record_id, 'end_offset > start_offset' AS detail FROM span WHERE start_offset % 37 = 0 AND start_offset > 0
UNION ALL SELECT 'INVALID_IR', 'es_' || substr(sha256(doc_id || '-' || start_offset), 1, 20), 'content_sha256: hex64' FROM span WHERE start_offset % 41 = 0
UNION ALL SELECT 'INVALID_IR', 'es_' || substr(sha256(doc_id || '-' || start_offset), 1, 20), 'span_kind: in:prose|list-item|table-row|media|code|link|other' FROM span WHERE start_offset % 43 = 0""")
def p_record_schema(spark, d):
    s = derive.spans(spark, d)
    at = F.col("start_offset")
    key = F.concat(F.lit("es_"), F.substring(F.sha2(F.concat_ws("-", "doc_id", at), 256), 1, 20))
    rows = s.select(
        key.alias("evidence_span_id"), F.concat(F.lit("eu_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20)).alias("evidence_unit_id"), at, F.when(at % 37 == 0, at).otherwise(F.col("end_offset")).alias("end_offset"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.when(at % 41 == 0, "none").otherwise(F.sha2("content", 256)).alias("content_sha256"), "content", F.when(at % 43 == 0, "poem").otherwise(F.col("span_kind")).alias("span_kind"),
    )
    return schemas.violations("evidence_spans", rows.withColumn("end_offset", F.greatest("end_offset", F.lit(1).cast("long"))))


@query(f"""WITH {CANONICAL_SQL}, e AS (SELECT unnest(supporting) AS src, canonical_claim_id AS dst, 'supports' AS type FROM canonical UNION ALL SELECT unnest(opposing), canonical_claim_id, 'opposes' FROM canonical UNION ALL SELECT 'cc_parent', canonical_claim_id, 'derived-from' FROM canonical WHERE derived),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT canonical_claim_id FROM canonical UNION SELECT 'cc_newer' FROM canonical WHERE superseded)
SELECT 'node' AS part, node AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS type FROM n UNION ALL SELECT 'edge', src, dst, type FROM e UNION ALL SELECT 'supersession', 'cc_newer', canonical_claim_id, NULL FROM canonical WHERE superseded""")
def g_export(spark, d):
    k = derive.canonical(spark, d).withColumn("supersedes", F.array().cast("array<string>"))
    return graph.records(graph.provenance_edges(k), graph.supersession_edges(k), k)


#: A page a part: its number decides type, status and which rules it breaks.
_PART_PAGES = """WITH w AS (SELECT p_partkey AS k, p_name, 'p/' || p_partkey || '.md' AS path, ['concept', 'comparison', 'map'][1 + p_partkey % 3] AS kind, p_size % 7 AS s FROM part),
q AS (SELECT *, ['single-source', 'multi-source', 'disputed', 'superseded', 'derived', 'derived-note-only', 'insufficient-evidence'][1 + s] AS status FROM w)"""


def _part_pages(spark, d):
    """(planned pages, claims): Markdown pages with front matter, made from the parts table."""
    k = F.col("p_partkey")
    cc = F.concat(F.lit("cc_part"), k)
    kind = F.element_at(F.array(F.lit("concept"), F.lit("comparison"), F.lit("map")), F.pmod(k, F.lit(3)).cast("int") + 1)
    at = F.pmod("p_size", F.lit(7)).cast("int")
    shown = F.element_at(F.array(*map(F.lit, ("one source", "many sources", "存在争议", "Superseded", "derived", "derived-note", "证据不足"))), at + 1)
    when = lambda n, yes, no="": F.when(k % n == 0, yes).otherwise(F.lit(no) if isinstance(no, str) else no)
    summary = F.concat(*(F.concat(F.lit(f"  {s}: "), F.when(at == i, "1").otherwise("0"), F.lit("\n")) for i, s in enumerate(support.STATUSES)))
    head = F.concat(F.lit("---\nknowledge_base: kb\npage_id: page-"), k, F.lit("\npage_type: "), kind, when(11, "\nbuild_id: b2", "\nbuild_id: b1"), when(13, "\nextra: 1"), F.lit("\nepistemic_summary:\n"), when(17, F.concat(F.lit("  other: 3\n"), summary), summary), F.lit("---\n"))
    cite = F.concat(F.lit(" [^"), cc, F.lit("]"))
    sections = F.when(kind == "concept", "## 前提与局限").when(kind == "comparison", "## 适用边界").otherwise("## More")
    first = F.when(kind == "concept", "## 核心主张").otherwise("## 比较结论")
    body = F.concat(
        F.lit("# "), F.col("p_name"), F.lit("\n\n"), first, F.lit("\n\n"), F.col("p_name"), when(19, "", cite), F.lit(" "), when(23, "", shown), F.lit("\n\n"), when(29, "", sections), F.lit("\n\n- "), F.col("p_brand"), cite,
        when(37, "\n\n[pic]: ![x](https://h/i.png)"), when(41, "\n\n[path] /tmp/x"), F.lit("\n\n## 开放问题\n\nopen\n\n## 证据\n\n[^"), when(31, "cc_other", cc), F.lit("]: source\n"),
    )
    rows = spread(table(spark, d, "part")).select(F.concat(F.lit("page-"), k).alias("page_id"), kind.alias("page_type"), F.concat(F.lit("p/"), k, F.lit(".md")).alias("path"), F.array(cc).alias("claim_ids"), F.concat(head, body).alias("markdown"), cc.alias("canonical_claim_id"), F.element_at(F.array(*map(F.lit, support.STATUSES)), at + 1).alias("status"))
    plan = rows.select("page_id", "page_type", "path", "claim_ids")
    return plan.join(stored(pages.parsed(rows.select("path", "markdown"))), "path"), rows.select("canonical_claim_id", "status")


@query(_PART_PAGES + """
SELECT 'INVALID_PAGE_FRONTMATTER' AS rule_code, path AS record_id, 'keys' AS detail FROM q WHERE k % 13 = 0 UNION ALL SELECT 'INVALID_PAGE_FRONTMATTER', path, 'build_id' FROM q WHERE k % 11 = 0 AND k % 13 <> 0
UNION ALL SELECT 'INVALID_PAGE_STATUS', path, NULL FROM q WHERE k % 17 = 0""")
def p_page_front_matter(spark, d):
    planned, claims = _part_pages(spark, d)
    return pages.front_matter_rules(planned, claims, "kb", "b1")


@query(_PART_PAGES + """
SELECT 'UNSAFE_PAGE_CONTENT' AS rule_code, path AS record_id, CAST(NULL AS VARCHAR) AS detail FROM q WHERE k % 37 = 0 OR k % 41 = 0 UNION ALL SELECT 'PAGE_CITATION_CLOSURE', path, NULL FROM q WHERE k % 31 = 0
UNION ALL SELECT 'MISSING_PAGE_SECTION', path, CASE kind WHEN 'concept' THEN '前提与局限' ELSE '适用边界' END FROM q WHERE k % 29 = 0 AND kind <> 'map'
UNION ALL SELECT 'UNCITED_FACTUAL_BLOCK', path, trim(p_name || ' ' || CASE WHEN k % 23 = 0 THEN '' ELSE ['one source', 'many sources', '存在争议', 'Superseded', 'derived', 'derived-note', '证据不足'][1 + s] END) FROM q WHERE k % 19 = 0 AND kind <> 'map'
UNION ALL SELECT 'HIDDEN_EPISTEMIC_STATUS', 'page-' || k || '/cc_part' || k, status FROM q WHERE k % 23 = 0 AND s >= 2""")
def p_page_rules(spark, d):
    planned, claims = _part_pages(spark, d)
    return pages.content_rules(planned, claims)


@query("""WITH r AS (SELECT o_orderkey AS job, ['publish', 'evaluate', 'pages', 'canonical-claims', 'evidence-claims', 'suggest-alignments'][1 + o_custkey % 6] AS command,
  ['prepared', 'evidence-validated', 'canonical-validated', 'pages-validated', 'evaluation-passed', 'evaluation-blocked', 'publish-failed', 'published'][1 + o_orderkey % 8] AS stage FROM orders),
a AS (SELECT * FROM (VALUES ('publish', 'evaluation-passed'), ('publish', 'publish-failed'), ('evaluate', 'pages-validated'), ('evaluate', 'evaluation-passed'), ('evaluate', 'evaluation-blocked'), ('pages', 'canonical-validated'), ('pages', 'pages-validated'),
  ('canonical-claims', 'evidence-validated'), ('canonical-claims', 'canonical-validated'), ('suggest-alignments', 'evidence-validated'), ('suggest-alignments', 'canonical-validated'), ('evidence-claims', 'prepared'), ('evidence-claims', 'evidence-validated')) v(command, stage))
SELECT CASE WHEN command = 'publish' THEN 'PUBLISH_GATE' ELSE 'STAGE_GATE' END AS rule_code, CAST(job AS VARCHAR) AS record_id, CASE WHEN command = 'publish' THEN stage ELSE command || ' after ' || stage END AS detail
FROM r ANTI JOIN a USING (command, stage)""")
def p_publish_gate(spark, d):
    o = table(spark, d, "orders")
    commands = F.array(*map(F.lit, ("publish", "evaluate", "pages", "canonical-claims", "evidence-claims", "suggest-alignments")))
    stages = F.array(*map(F.lit, ("prepared", "evidence-validated", "canonical-validated", "pages-validated", "evaluation-passed", "evaluation-blocked", "publish-failed", "published")))
    return rules.stage_rules(o.select(F.col("o_orderkey").alias("job"), F.get(commands, (F.col("o_custkey") % 6).cast("int")).alias("command"), F.get(stages, (F.col("o_orderkey") % 8).cast("int")).alias("stage")))


@query("""WITH k AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS last FROM part), e AS (SELECT k, 'ec_' || k AS ec FROM k)
SELECT 'CONTRADICTORY_EDGE' AS rule_code, 'cc_' || k AS record_id, CAST(NULL AS VARCHAR) AS detail FROM k WHERE k % 10 = 0 AND k % 15 <> 7
UNION ALL SELECT 'EVIDENCE_CLOSURE', 'cc_' || k, NULL FROM k WHERE k % 15 = 7 AND k % 22 <> 3
UNION ALL SELECT 'UNKNOWN_EVIDENCE_CLAIM', 'ec_' || k, NULL FROM k WHERE k % 9 = 4 AND k % 15 <> 7
UNION ALL SELECT DISTINCT 'UNKNOWN_CONCEPT', 'concept_49', NULL FROM k WHERE k % 50 = 49
UNION ALL SELECT DISTINCT 'UNKNOWN_CANONICAL_CLAIM', 'cc_missing', NULL FROM k WHERE k % 22 = 3
UNION ALL SELECT 'INVALID_CONCEPT_BACKREF', 'cc_' || k, 'concept_' || k % 50 FROM k WHERE k % 7 = 0 AND k % 50 <> 49
UNION ALL SELECT DISTINCT 'INVALID_CONCEPT_BACKREF', 'cc_zzz', 'concept_5' FROM k WHERE k % 50 = 5
UNION ALL SELECT 'SUPERSESSION_BACKREF', new, old FROM (SELECT 'cc_' || k AS new, 'cc_' || (k + 1) AS old FROM k WHERE k % 3 = 0 AND k < last AND (k + 1) % 4 <> 1 UNION ALL SELECT 'cc_' || (k - 1), 'cc_' || k FROM k WHERE k % 4 = 1 AND (k - 1) % 3 <> 0)
UNION ALL SELECT 'QUALIFIER_LOSS', 'cc_' || k, 'ec_' || k FROM k WHERE k % 6 = 0 AND k % 15 <> 7 AND k % 9 <> 4
UNION ALL SELECT 'QUALIFIER_LOSS', 'cc_' || k, 'ec_' || k FROM k WHERE k % 6 = 0 AND k % 10 = 0 AND k % 15 <> 7 AND k % 9 <> 4""")
def p_canonical_rules(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part").select(k)
    last = part.agg(F.max(k)).first()[0]
    none = F.array().cast("array<string>")
    some = lambda when, value: F.when(when, F.array(value)).otherwise(none)
    ec, cc = F.concat(F.lit("ec_"), k), lambda x: F.concat(F.lit("cc_"), x)
    bare = k % 15 == 7
    canonical = part.select(
        cc(k).alias("canonical_claim_id"), some(~bare, ec).alias("supporting"), some((k % 10 == 0) & ~bare, ec).alias("opposing"), some(k % 22 == 3, F.lit("cc_missing")).alias("derived_from"),
        some((k % 3 == 0) & (k < last), cc(k + 1)).alias("supersedes"), some(k % 4 == 1, cc(k - 1)).alias("superseded_by"), F.array(F.concat(F.lit("concept_"), k % 50)).alias("concept_ids"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("scope"), none.alias("conditions"),
    )
    claims = part.where(k % 9 != 4).select(ec.alias("evidence_claim_id"), F.lit(None).cast("string").alias("time"), F.when(k % 6 == 0, "en").alias("scope"), none.alias("conditions"))
    of = part.where(k % 50 != 49).groupBy((k % 50).alias("c")).agg(F.collect_list(F.when(k % 7 != 0, cc(k))).alias("claim_ids"))
    concepts = of.select(F.concat(F.lit("concept_"), "c").alias("concept_id"), "claim_ids", some(F.col("c") == 5, F.lit("cc_zzz")).alias("definition_claim_ids"))
    return rules.canonical_rules(canonical, claims, concepts)
