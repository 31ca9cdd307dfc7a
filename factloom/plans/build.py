"""A knowledge build as a chain of DataFrame functions: prepare, gate, publish.

Each step takes and returns a dict of tables. What an outside reader writes - claims, reviews, canonical
claims, decisions, pages, probe results - comes in as tables; the gates only accept or refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import identity, incremental, pages, rules, segment, support
from factloom.sources.markdown import front_matter, limits
from factloom.sources.records import Publication

Tables = dict[str, DataFrame]


class GateClosed(ValueError):
    """A gate refused; violations holds up to a hundred of the rows that say why."""

    def __init__(self, stage: str, violations: DataFrame):
        self.violations = violations.limit(100).collect()
        super().__init__(f"{stage}: " + ", ".join(sorted({r.rule_code for r in self.violations})))


def gate(stage: str, *found: DataFrame) -> None:
    bad = rules.union(*found)
    if not rules.is_open(bad):
        raise GateClosed(stage, bad)


def prepare(files: DataFrame, previous: Tables | None = None, need_tags: bool = False, prefix: str = "factloom_") -> Tables:
    """Sources, units, spans and the work set from (path, markdown, byte_size, content_sha256).

    prefix begins the front-matter keys by which a note overrides its identity: source, publisher,
    corpus and independence_group.
    """
    gate("prepare", limits(files))
    parsed = files.withColumn("f", front_matter("markdown"))
    gate("prepare", rules.violations(parsed, "INVALID_FRONTMATTER", F.col("path"), F.col("f.problem").isNotNull(), F.col("f.problem")))
    get = lambda k: F.nullif(F.trim(F.get_json_object("f.metadata", f"$.{k}")), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?i)\.md$", "")
    flat = parsed.select(
        "path", "markdown", "byte_size", "content_sha256", get("source_url").alias("source_url"), F.coalesce(get("title"), stem).alias("title"), get("author").alias("author"),
        get(prefix + "publisher").alias("publisher"), get(prefix + "corpus").alias("corpus"), get(prefix + "independence_group").alias("independence_group"),
        identity.source_kind(stem, get("source_url"), F.json_object_keys("f.metadata"), get(prefix + "source"), need_tags).alias("source_kind"), F.col("f.body").alias("body"), F.col("f.body_line").alias("body_line"),
    )
    before = (previous or {}).get("sources")
    if before is None:
        before = files.sparkSession.createDataFrame([], "source_id string, path string, source_url string, content_sha256 string")
    named = identity.variant_groups(incremental.carried_ids(flat, before))
    sources = identity.identities(named).withColumn("evidence_tier", identity.tier(F.col("source_kind"))).withColumn("vault_relative_path", F.col("path"))
    units = segment.evidence_units(sources.where(F.col("path") == F.col("extraction_path")))
    spans = segment.evidence_spans(units)
    changed = incremental.changed_sources(sources, before)
    return {
        "sources": sources.drop("body", "body_line", "markdown"), "evidence_units": units, "primary_anchors": segment.primary_anchors(units, sources), "evidence_spans": spans, "changed_sources": changed,
        "deleted_sources": incremental.deleted_sources(sources, before), "work_units": incremental.work_set(units, changed), "files": sources.select("path", "markdown"),
    }


#: Tables that a build may lack, and their columns.
OPTIONAL = {
    "primary_support_reviews": "evidence_claim_id string, decision string, primary_anchor_ids array<string>",
    "alignment_decisions": "alignment_candidate_id string, decision string",
}


def _given(t: Tables, name: str, like: DataFrame) -> DataFrame:
    return t[name] if name in t else like.sparkSession.createDataFrame([], OPTIONAL[name])


def carry(t: Tables, previous: Tables) -> Tables:
    """t with the previous claims, dispositions and reviews of unchanged sources whose span still exists.

    Ids that both sides have are refused.
    """
    gone = t["changed_sources"].select("source_id").unionByName(t["deleted_sources"].select("source_id"))
    units = previous["evidence_units"].select("evidence_unit_id", "source_id").distinct()
    kept = {
        name: incremental.carry_forward(previous[name].join(units, "evidence_unit_id"), t["evidence_spans"], gone).select(*previous[name].columns)
        for name in ("evidence_claims", "span_dispositions")
    }
    claims, twice = incremental.merge(kept["evidence_claims"].select(*t["evidence_claims"].columns), t["evidence_claims"], "evidence_claim_id")
    told, again = incremental.merge(kept["span_dispositions"].select(*t["span_dispositions"].columns), t["span_dispositions"], "evidence_span_id")
    gate("carry", twice, again)
    out = {**t, "evidence_claims": claims, "span_dispositions": told}
    if "primary_support_reviews" in previous:
        old = previous["primary_support_reviews"].join(kept["evidence_claims"].select("evidence_claim_id"), "evidence_claim_id", "left_semi")
        new = _given(t, "primary_support_reviews", claims)
        out["primary_support_reviews"] = old.select(*new.columns).unionByName(new)
    return out


def check_evidence(t: Tables, previous: Tables | None = None) -> Tables:
    """Gate on claims, dispositions and reviews of the work set, then on all of them with what carries over."""
    claims, spans = t["evidence_claims"], t["evidence_spans"]
    work = spans.join(t["work_units"].select("evidence_unit_id"), "evidence_unit_id", "left_semi")
    joined = rules.provenance(claims, spans, t["evidence_units"], t["sources"])
    gate(
        "evidence", rules.duplicates(claims, "evidence_claim_id"), rules.claim_rules(claims), rules.missing(claims, "evidence_span_id", spans, "evidence_span_id", "UNKNOWN_EVIDENCE_SPAN"),
        rules.evidence_rules(joined), rules.disposition_rules(work, t["span_dispositions"], claims),
        rules.anchor_rules(claims, t["primary_anchors"]), rules.review_rules(joined, _given(t, "primary_support_reviews", claims)),
    )
    if previous is None or "evidence_claims" not in previous:
        return {**t, "provenance": joined}
    whole = carry(t, previous)
    gate("evidence", rules.coverage(spans, "evidence_span_id", whole["span_dispositions"], "evidence_span_id", "INCOMPLETE_SPAN_COVERAGE"))
    return {**whole, "provenance": rules.provenance(whole["evidence_claims"], spans, t["evidence_units"], t["sources"])}


def check_canonical(t: Tables) -> Tables:
    """Gate on canonical claims and alignment decisions; adds derived counts and statuses."""
    canonical = t["canonical_claims"]
    found = [
        rules.violations(canonical.agg(F.count("*").alias("n")), "NO_CANONICAL_CLAIMS", F.lit("canonical_claims"), F.col("n") == 0),
        rules.duplicates(canonical, "canonical_claim_id"), rules.canonical_rules(canonical, t["evidence_claims"], t["concepts"]),
    ]
    if "alignment_candidates" in t:
        found.append(rules.decision_rules(t["alignment_candidates"], _given(t, "alignment_decisions", canonical), canonical))
    gate("canonical", *found)
    gate("canonical", rules.graph_rules(canonical))
    return {**t, "canonical_status": support.with_status(support.support_counts(canonical, t["provenance"]))}


def check_pages(t: Tables, knowledge_base: str, build_id: str) -> Tables:
    """Gate on pages (path, markdown) and their plan; adds page records."""
    claims = t["canonical_status"].select("canonical_claim_id", "status")
    gate("pages", pages.page_rules(t["pages"], t["page_plan"], claims, t["concepts"], knowledge_base, build_id))
    return {**t, "page_records": pages.page_records(t["pages"], t["page_plan"], claims)}


def check_evaluation(t: Tables) -> Tables:
    """Gate on probes and their results; adds outcomes and the row of metrics."""
    canonical, probes, results = t["canonical_status"], t["probes"], t["probe_results"]
    gate("evaluation", rules.probe_rules(probes, results, canonical))
    outcomes = support.probe_outcomes(probes, results, canonical)
    cited = pages.parsed(t["pages"]).select(F.explode("cited").alias("canonical_claim_id")).distinct().withColumn("cited", F.lit(True))
    edges = F.size("supporting") + F.size("opposing") + F.size("derived_from") > 0
    closure = canonical.join(cited, "canonical_claim_id", "left").select(F.lit(True).alias("published"), F.coalesce("cited", F.lit(False)).alias("cited"), edges.alias("has_evidence"))
    told = t["span_dispositions"].select("evidence_span_id", F.lit(True).alias("processed"))
    spans = t["evidence_spans"].select("evidence_span_id").join(told, "evidence_span_id", "left").select("evidence_span_id", F.coalesce("processed", F.lit(False)).alias("processed"))
    metrics = support.metrics(outcomes, closure, spans)
    blocked = support.gate_failures(metrics)
    gate("evaluation", rules.violations(blocked, "EVALUATION_BLOCKED", F.col("gate"), F.lit(True), F.col("gate")))
    return {**t, "probe_outcomes": outcomes, "evaluation": metrics}


def unchanged(sources: DataFrame, now: DataFrame) -> DataFrame:
    """Sources whose file is gone or differs from what was prepared; now: (path, content_sha256)."""
    a = sources.select("path", F.col("content_sha256").alias("sha256"))
    lost = incremental.drift(a, now.select("path", F.col("content_sha256").alias("sha256"))).where("drift != 'unknown'")
    return rules.violations(lost, "SOURCE_CHANGED", F.col("path"), F.lit(True), F.col("drift"))


def publish(publication: Publication, t: Tables, fingerprint: str, now: DataFrame | None = None, build_id: str | None = None) -> dict:
    """Publish all tables; what was written is verified from what can be read back.

    now: the source files as they are, of which none may have changed since it was prepared.
    """
    from factloom.plans.verify import verify_tables

    if now is not None:
        gate("publish", unchanged(t["sources"], now))

    def verify(read) -> None:
        gate("publish", verify_tables({name: read(name) for name in t}))

    return publication.publish(t, fingerprint, verify, build_id)
