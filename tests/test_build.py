import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from factloom.plans import build, verify
from factloom.sources.records import Publication
from factloom.streaming import folder

USER = "---\ntitle: {0}\nfactloom_source: user-authored\n---\n# Finding\n\n{1}\n"


def files(spark, notes):
    df = spark.createDataFrame(list(notes.items()), "path string, markdown string")
    return df.withColumn("byte_size", F.octet_length("markdown").cast("long")).withColumn("content_sha256", F.sha2("markdown", 256))


def with_claims(t, miss=0):
    """Every span as a claim, as an outside reader would write them."""
    s = t["evidence_spans"].join(t["evidence_units"].select("evidence_unit_id", "source_id"), "evidence_unit_id").join(t["sources"].select("source_id", "evidence_tier").distinct(), "source_id")
    claim = F.concat(F.lit("ec_"), F.substring("evidence_span_id", 4, 20))
    none = F.array().cast("array<string>")
    origin = F.when(F.col("evidence_tier").isin("user-authored", "unverified-local", "derived-note"), F.col("evidence_tier")).otherwise("primary-source")
    claims = s.select(
        claim.alias("evidence_claim_id"), "evidence_unit_id", "evidence_span_id", F.col("content").alias("statement"), F.lit("fact").alias("claim_type"), F.lit("asserted").alias("modality"), F.lit("has").alias("predicate"),
        F.lit(None).cast("string").alias("attribution"), origin.alias("evidence_origin"), none.alias("primary_anchor_ids"), F.lit(None).cast("string").alias("primary_support_status"), F.col("content").alias("supporting_excerpt"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("scope"), none.alias("conditions"),
    )
    kept = claims.orderBy("evidence_span_id").limit(max(0, claims.count() - miss))
    disp = kept.select("evidence_span_id", F.lit("extracted").alias("status"), F.array("evidence_claim_id").alias("claim_ids"), F.lit(None).cast("string").alias("reason"))
    return {**t, "evidence_claims": claims, "span_dispositions": disp}


def with_canonical(t):
    none = F.array().cast("array<string>")
    key = F.concat(F.lit("cc_"), F.substring(F.sha2("statement", 256), 1, 10))
    c = t["evidence_claims"].groupBy("statement").agg(F.collect_list("evidence_claim_id").alias("supporting"))
    c = c.select(key.alias("canonical_claim_id"), "supporting", none.alias("opposing"), none.alias("derived_from"), none.alias("supersedes"), none.alias("superseded_by"), F.array(F.lit("concept_1")).alias("concept_ids"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("scope"), none.alias("conditions"))
    concepts = c.agg(F.collect_list("canonical_claim_id").alias("claim_ids")).select(F.lit("concept_1").alias("concept_id"), none.alias("definition_claim_ids"), "claim_ids")
    return {**t, "canonical_claims": c, "concepts": concepts}


NOTES = {"a.md": USER.format("A", "Caching helps. It is fast."), "b.md": "# Finding\n\nCaching helps.\n", "d/c.md": "---\nsource_url: https://h/c\n---\ntext one\n\n- item. more\n"}


def test_a_whole_build(spark, tmp_path):
    t = build.prepare(files(spark, NOTES))
    kinds = {r.path: (r.source_kind, r.evidence_tier) for r in t["sources"].collect()}
    assert kinds["a.md"] == ("user-note", "user-authored") and kinds["b.md"] == ("unknown-markdown", "unverified-local")
    t = build.check_canonical(with_canonical(build.check_evidence(with_claims(t))))
    status = {r.statement: (r.status, r.independent_count) for r in t["canonical_status"].join(t["evidence_claims"].select(F.col("evidence_claim_id").alias("e"), "statement"), F.array_contains("supporting", F.col("e"))).collect()}
    assert status["Caching helps."] == ("multi-source", 2) and status["It is fast."] == ("single-source", 1)
    pub = Publication(spark, str(tmp_path / "kb"))
    names = ("sources", "evidence_units", "evidence_spans", "files", "evidence_claims", "canonical_status")
    assert build.publish(pub, {n: t[n] for n in names}, "f")["status"] == "published"
    assert pub.read("evidence_spans").count() == 6


def test_gates_refuse(spark):
    t = build.prepare(files(spark, NOTES))
    with pytest.raises(build.GateClosed, match="INCOMPLETE_SPAN_COVERAGE"):
        build.check_evidence(with_claims(t, miss=1))
    bad = with_claims(t)
    bad["evidence_claims"] = bad["evidence_claims"].withColumn("supporting_excerpt", F.lit("not there"))
    with pytest.raises(build.GateClosed, match="UNGROUNDED_EXCERPT"):
        build.check_evidence(bad)
    with pytest.raises(build.GateClosed, match="INVALID_FRONTMATTER"):
        build.prepare(files(spark, {"x.md": "---\nopen"}))
    with pytest.raises(build.GateClosed, match="NO_SOURCES"):
        build.prepare(files(spark, NOTES).where("false"))


def test_cycles_reviews_and_anchors_are_gated(spark):
    course = "---\ntitle: V\nauthor: x\nsource_url: https://www.youtube.com/watch?v=abc\n---\n# [https://youtu.be/abc?t=42] Concept\n\nA note says it.\n"
    t = with_claims(build.prepare(files(spark, {**NOTES, "v.md": course})))
    anchors = t["primary_anchors"].collect()
    assert [(a.locator, a.verification_status) for a in anchors] == [("https://youtu.be/abc?t=42", "unavailable")]
    with pytest.raises(build.GateClosed, match="PRIMARY_REVIEW_REQUIRED"):
        build.check_evidence(t)
    note = F.col("evidence_origin") == "derived-note"
    claims = t["evidence_claims"].withColumn("primary_support_status", F.when(note, "partial")).withColumn("primary_anchor_ids", F.when(note, F.array(F.lit(anchors[0].primary_anchor_id))).otherwise(F.col("primary_anchor_ids")))
    reviews = claims.where(note).select("evidence_claim_id", F.lit("partial").alias("decision"), "primary_anchor_ids")
    t = {**t, "evidence_claims": claims, "primary_support_reviews": reviews}
    with pytest.raises(build.GateClosed, match="INVALID_PRIMARY_ANCHOR"):
        build.check_evidence({**t, "evidence_claims": claims.withColumn("primary_anchor_ids", F.array(F.lit("pa_x")))})
    with pytest.raises(build.GateClosed, match="PRIMARY_EVIDENCE_REQUIRED"):
        none = F.array().cast("array<string>")
        build.check_evidence({**t, "evidence_claims": claims.withColumn("primary_anchor_ids", none), "primary_support_reviews": reviews.withColumn("primary_anchor_ids", none)})
    t = with_canonical(build.check_evidence(t))
    ids = sorted(r.canonical_claim_id for r in t["canonical_claims"].collect())[:2]
    other = F.when(F.col("canonical_claim_id") == ids[0], ids[1]).when(F.col("canonical_claim_id") == ids[1], ids[0])
    ring = F.filter(F.array(other), lambda x: x.isNotNull())
    with pytest.raises(build.GateClosed, match="PROVENANCE_CYCLE"):
        build.check_canonical({**t, "canonical_claims": t["canonical_claims"].withColumn("derived_from", ring)})
    with pytest.raises(build.GateClosed, match="SUPERSESSION_CYCLE"):
        build.check_canonical({**t, "canonical_claims": t["canonical_claims"].withColumn("supersedes", ring).withColumn("superseded_by", ring)})
    with pytest.raises(build.GateClosed, match="NO_CANONICAL_CLAIMS"):
        build.check_canonical({**t, "canonical_claims": t["canonical_claims"].where("false")})


def test_verification_recomputes_claims_and_statuses(spark):
    t = build.check_canonical(with_canonical(build.check_evidence(with_claims(build.prepare(files(spark, NOTES))))))
    names = ("sources", "evidence_units", "evidence_spans", "files", "evidence_claims", "span_dispositions", "canonical_status")
    whole = {n: t[n] for n in names}
    codes = lambda **x: {r.rule_code for r in verify.verify_tables({**whole, **x}).collect()}
    assert codes() == set()
    assert codes(canonical_status=t["canonical_status"].withColumn("work_count", F.lit(9).cast("long"))) == {"VERIFY_COUNTS"}
    assert codes(canonical_status=t["canonical_status"].withColumn("status", F.lit("disputed"))) == {"VERIFY_STATUS"}
    assert codes(evidence_claims=t["evidence_claims"].withColumn("supporting_excerpt", F.lit("other"))) == {"VERIFY_EXCERPT"}
    assert codes(span_dispositions=t["span_dispositions"].limit(5)) == {"VERIFY_DISPOSITION", "VERIFY_SPAN_COVERAGE"}


def test_the_graph_record(spark):
    import json

    from factloom.operators import graph

    none = "cast(array() as array<string>)"
    k = spark.sql(f"SELECT 'cc_a' AS canonical_claim_id, array('ec_2', 'ec_1') AS supporting, array('ec_3') AS opposing, {none} AS derived_from, array('cc_b') AS supersedes, {none} AS superseded_by UNION ALL SELECT 'cc_b', {none}, {none}, array('cc_a'), {none}, array('cc_a') UNION ALL SELECT 'cc_c', {none}, {none}, {none}, {none}, {none}")
    got = json.loads(graph.export(graph.provenance_edges(k), graph.supersession_edges(k), k).first().graph)
    assert got["nodes"] == ["cc_a", "cc_b", "cc_c", "ec_1", "ec_2", "ec_3"] and got["supersession_edges"] == [{"from": "cc_a", "to": "cc_b"}]
    assert [(e["from"], e["to"], e["type"]) for e in got["edges"]] == [("cc_a", "cc_b", "derived-from"), ("ec_1", "cc_a", "supports"), ("ec_2", "cc_a", "supports"), ("ec_3", "cc_a", "opposes")]


def test_verification_sees_tampering(spark):
    t = build.prepare(files(spark, NOTES))
    base = {n: t[n] for n in ("sources", "evidence_units", "evidence_spans", "files")}
    assert verify.verify_tables(base).collect() == []
    def codes(x):
        return {r.rule_code for r in verify.verify_tables(x).collect()}

    assert "VERIFY_SOURCE_CHANGED" in codes({**base, "files": t["files"].withColumn("markdown", F.concat("markdown", F.lit(" ")))})
    assert codes({**base, "evidence_spans": t["evidence_spans"].where("content != 'It is fast.'")}) == {"VERIFY_SPAN_COVERAGE"}
    assert "VERIFY_SPAN" in codes({**base, "evidence_spans": t["evidence_spans"].withColumn("start_offset", F.col("start_offset") + 1)})


def test_verification_imports_nothing_of_the_build():
    tree = ast.parse(pathlib.Path(verify.__file__).read_text())
    names = {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    assert not [n for n in names if n and n.startswith("factloom.") and not n.startswith("factloom.functions")]


def test_increments_equal_a_clean_build(spark):
    one = build.prepare(files(spark, NOTES))
    later = {**NOTES, "b.md": "# Finding\n\nCaching helps a lot.\n", "new.md": "new", "moved/c.md": NOTES["d/c.md"]}
    del later["d/c.md"]
    two = build.prepare(files(spark, later), one)
    ids = lambda t: {r.path: r.source_id for r in t["sources"].collect()}
    a, b = ids(one), ids(two)
    assert b["moved/c.md"] == a["d/c.md"] and b["a.md"] == a["a.md"] and b["b.md"] == a["b.md"]
    changed = {r.source_id for r in two["changed_sources"].collect()}
    assert changed == {b["b.md"], b["new.md"], b["moved/c.md"]} and two["deleted_sources"].collect() == []
    clean = build.prepare(files(spark, later))
    text = lambda t: sorted((r.variant_path, r.content) for r in t["evidence_units"].collect())
    assert text(two) == text(clean)
    none = build.prepare(files(spark, later), two)
    assert none["changed_sources"].collect() == [] and none["work_units"].collect() == []


def test_folder_stream_equals_one_build(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    target, mark = str(tmp_path / "kb"), str(tmp_path / "mark")
    (drop / "a.md").write_text(USER.format("A", "x"))
    (drop / "b.md").write_text("# B")
    folder.start(spark, str(drop), target, mark, once=True).awaitTermination()
    pub = Publication(spark, target)
    first = {r.path: r for r in pub.read("sources").collect()}
    assert sorted(first) == ["a.md", "b.md"] and first["a.md"].title == "A"
    (drop / "c.md").write_text("# C")
    (drop / "d.md").write_text("---\nopen")
    folder.start(spark, str(drop), target, mark, once=True).awaitTermination()
    second = {r.path: r for r in pub.read("sources").collect()}
    assert sorted(second) == ["a.md", "b.md", "c.md"] and second["a.md"].source_id == first["a.md"].source_id
    state = pub.current()
    folder.apply_batch(pub, spark.createDataFrame([], "path string, markdown string, modified timestamp"), 0)
    assert pub.current() == state, "a replayed batch changes nothing"
