"""Support counts, derived status, page pivots and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.rules import evidence_edges, set_equal

#: Statuses in the order in which pages show them, a fixed value.
STATUSES = ("single-source", "multi-source", "disputed", "superseded", "derived", "derived-note-only", "insufficient-evidence")
#: Words by which a page shows a status, fixed values.
VISIBLE = {
    "disputed": r"(?i)争议|分歧|冲突|disput",
    "superseded": r"(?i)已取代|被替代|supersed",
    "derived": r"(?i)推导|派生|derived",
    "derived-note-only": r"(?i)仅来自课程笔记|derived[- ]note",
    "insufficient-evidence": r"(?i)证据不足|insufficient evidence",
}


def support_counts(canonical: DataFrame, provenance: DataFrame) -> DataFrame:
    """Distinct documents, works, independence groups and publishers behind each canonical claim.

    Supporting and opposing evidence both count; a claim without evidence has zeros. provenance: a row an evidence
    claim, met by the lists of the canonical claims, or a row (canonical_claim_id, ...) an edge already.

    Of edges that are given, pairs of documents and claims, which are the most, are counted apart, and of the other
    columns each combination stays once a claim before they are counted together.
    """
    key, each = "canonical_claim_id", ("work_id", "independence_group_id", "publisher_id")
    said = (F.col("evidence_origin") == "derived-note").alias("only_notes"), (F.coalesce(F.col("primary_support_status"), F.lit("")) != "verified").alias("some_unverified")
    flags = F.bool_and("only_notes").alias("only_notes"), F.bool_or("some_unverified").alias("some_unverified")
    sizes = [F.count_distinct(c).alias(n) for c, n in zip(each, ("work_count", "independent_count", "publisher_count"))]
    if key in provenance.columns:
        once = provenance.select(key, *each, *said).groupBy(key, *each).agg(*flags)
        documents = provenance.select(key, "document_id").distinct().groupBy(key).agg(F.count("document_id").alias("document_count"))
        counts = documents.join(once.groupBy(key).agg(*sizes, *flags), key)
    else:
        behind = provenance.select("evidence_claim_id", "document_id", *each, *said)
        counts = evidence_edges(canonical).join(behind, "evidence_claim_id").groupBy(key).agg(F.count_distinct("document_id").alias("document_count"), *sizes, *flags)
    zero = {f"{x}_count": 0 for x in ("document", "work", "independent", "publisher")}
    stated = [c for c in counts.columns if c in canonical.columns and c != "canonical_claim_id"]  # what a record states is derived anew
    return canonical.drop(*stated).join(counts, "canonical_claim_id", "left").fillna(zero).fillna(False, ["only_notes", "some_unverified"])


def with_status(counted: DataFrame) -> DataFrame:
    """The derived status of each claim; the first rule that fits decides. Of evidence and of other claims, claims have the
    lists or their sizes, such as supporting_count and superseded_by_count."""
    many = lambda side: F.col(f"{side}_count") if f"{side}_count" in counted.columns else F.size(side)
    status = (
        F.when(many("superseded_by") > 0, "superseded")
        .when(many("opposing") > 0, "disputed")
        .when((many("derived_from") > 0) & (many("supporting") == 0), "derived")
        .when(F.col("only_notes") & F.col("some_unverified"), "derived-note-only")
        .when(F.col("independent_count") >= 2, "multi-source")
        .when(F.col("independent_count") == 1, "single-source")
        .otherwise("insufficient-evidence")
    )
    return counted.withColumn("status", status)


def statuses(claims: DataFrame, canonical_id: Column) -> DataFrame:
    """(statement_id, canonical_claim_id, status) of each statement, from its evidence claims alone: no list is gathered,
    nothing is joined, and what no status asks for is not counted.

    claims: (statement_id, derived, superseded, opposing, independence_group_id, evidence_origin, primary_support_status), a row
    an evidence claim; canonical_id: a statement's canonical id by its statement_id. Statements that have an id in common
    share what is behind them. Claims come together a statement and group first, so that only one row of each moves on.
    """
    group, behind = F.col("independence_group_id"), Window.partitionBy("canonical_claim_id")
    each = claims.groupBy("statement_id", "derived", "superseded", "independence_group_id").agg(
        F.count_if(~F.col("opposing")).alias("supporting_count"), F.count_if("opposing").alias("opposing_count"),
        F.bool_and(F.col("evidence_origin") == "derived-note").alias("only_notes"), F.bool_or(F.coalesce(F.col("primary_support_status"), F.lit("")) != "verified").alias("some_unverified"),
    )
    # a status asks for no group, one or more; two stand for more
    groups = F.when(F.min(group).over(behind).isNull(), 0).when(F.min(group).over(behind) == F.max(group).over(behind), 1).otherwise(2)
    met = each.withColumn("canonical_claim_id", canonical_id).withColumns({
        "only_notes": F.bool_and("only_notes").over(behind), "some_unverified": F.bool_or("some_unverified").over(behind), "independent_count": groups,
    })
    return with_status(met.groupBy("canonical_claim_id", "statement_id").agg(
        F.sum("supporting_count").alias("supporting_count"), F.sum("opposing_count").alias("opposing_count"), F.max("independent_count").alias("independent_count"),
        *(F.bool_or(c).alias(c) for c in ("only_notes", "some_unverified")), *(F.bool_or(c).cast("int").alias(n) for c, n in (("derived", "derived_from_count"), ("superseded", "superseded_by_count"))),
    )).select("statement_id", "canonical_claim_id", "status")


def _listed(pages: DataFrame, claims: DataFrame, how: str, *more: str) -> DataFrame:
    """(page_id, canonical_claim_id, status) rows of pages that have claim_ids, that are a row a claim, or that are such rows
    already."""
    if "status" in pages.columns:
        return pages.select("page_id", *more, "canonical_claim_id", "status")
    one = F.explode_outer("claim_ids").alias("canonical_claim_id") if "claim_ids" in pages.columns else "canonical_claim_id"
    return pages.select("page_id", *more, one).join(claims.select("canonical_claim_id", "status"), "canonical_claim_id", how)


def status_pivot(pages: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(page_id, one count per status): all seven, zeros kept.

    pages: (page_id, claim_ids), or a row (page_id, canonical_claim_id) a claim; claims: (canonical_claim_id, status), not
    needed where a page's rows have a status already.
    """
    met = _listed(pages, claims, "left")
    return met.groupBy("page_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def hidden_status(pages: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Pages whose main text does not show the status of a claim that must be shown.

    pages: (page_id, main) with claim_ids or canonical_claim_id; claims: (canonical_claim_id, status), not needed where a
    page's rows have a status already.
    """
    from factloom.operators.rules import violations

    met = _listed(pages, claims, "inner", "main")
    hidden = F.lit(False)
    for status, pattern in VISIBLE.items():
        hidden = hidden | ((F.col("status") == status) & ~F.col("main").rlike(pattern))
    return violations(met, "HIDDEN_EPISTEMIC_STATUS", F.concat_ws("/", "page_id", "canonical_claim_id"), hidden, F.col("status"))


def page_plan_rules(plan: DataFrame, files: DataFrame, concepts: DataFrame, index: DataFrame) -> DataFrame:
    """Page plans: unique safe paths, an index that links each, ownership by page type, no drift.

    plan: (page_id, page_type, path, claim_ids, concept_ids); files: (path); concepts: (concept_id,
    claim_ids); index: one row (text).
    """
    from factloom.functions.urls import is_safe_relative
    from factloom.operators.rules import coverage, duplicates, union, violations

    key = F.col("page_id")
    own = concepts.select(F.col("concept_id").alias("own"), F.col("claim_ids").alias("own_claims"))
    single = plan.where(F.col("page_type") == "concept").withColumn("own", F.get("concept_ids", F.lit(0))).join(own, "own", "left")
    linked = plan.crossJoin(F.broadcast(index.limit(1)))
    return union(
        duplicates(plan, "path", "DUPLICATE_PAGE_PATH"),
        violations(plan, "INVALID_PAGE_PATH", key, ~is_safe_relative(F.col("path")) | ~F.lower("path").endswith(".md"), F.col("path")),
        violations(plan.agg(F.max(F.col("path") == "index.md").alias("there")), "MISSING_INDEX", F.lit("index.md"), ~F.coalesce("there", F.lit(False))),
        coverage(plan, "path", files, "path", "PAGE_PLAN_DRIFT"),
        violations(single, "INVALID_CONCEPT_PAGE", key, (F.size("concept_ids") != 1) | F.col("own_claims").isNull() | ~set_equal(F.col("claim_ids"), F.col("own_claims"))),
        violations(plan, "INVALID_COMPARISON_PAGE", key, (F.col("page_type") == "comparison") & ((F.size("concept_ids") < 2) | (F.size("claim_ids") < 1))),
        violations(linked, "INDEX_COVERAGE", key, (F.col("path") != "index.md") & ~F.col("text").contains(F.col("path")), F.col("path")),
    )


def probe_outcomes(probes: DataFrame, results: DataFrame, canonical: DataFrame) -> DataFrame:
    """(probe_id, kind, expected_behavior, behavior, passed, entailment_ok) of each probe.

    An answer passes if its citations are exactly those required and its entailment is verified; an
    abstention if it cites nothing. Unknown citations fail, and so do gold results that no person
    reviewed, whose entailment then counts as open too.
    """
    r = results.select("probe_id", "behavior", "cited_claim_ids", "entailment_status", F.col("reviewer_type").alias("reviewed_by"))
    both = probes.join(r, "probe_id", "left")
    cited = both.select("probe_id", F.explode("cited_claim_ids").alias("canonical_claim_id"))
    unknown = cited.join(canonical.select("canonical_claim_id"), "canonical_claim_id", "left_anti").select("probe_id").distinct().withColumn("unknown", F.lit(True))
    met = both.join(unknown, "probe_id", "left")
    answer = F.col("expected_behavior") == "answer"
    unreviewed = (F.col("kind") == "gold") & ~F.col("reviewed_by").eqNullSafe(F.lit("human"))
    entailed = F.col("entailment_status").eqNullSafe(F.lit("verified"))
    right = F.when(answer, set_equal(F.col("cited_claim_ids"), F.col("required_claim_ids")) & entailed).otherwise(F.size("cited_claim_ids") == 0)
    passed = F.coalesce((F.col("behavior") == F.col("expected_behavior")) & right & F.col("unknown").isNull() & ~unreviewed, F.lit(False))
    return met.select("probe_id", "kind", "expected_behavior", "behavior", passed.alias("passed"), (~unreviewed & (~answer | entailed)).alias("entailment_ok"))


def metrics(outcomes: DataFrame, closure: DataFrame, spans: DataFrame) -> DataFrame:
    """One row of rates; null where nothing was asked, but 1 where no span was to be processed.

    closure: (canonical_claim_id, published, cited, has_evidence); spans: (evidence_span_id, processed).
    """
    def rate(when: str, of: str):
        return (F.count_if(F.expr(when) & F.expr(of)) / F.nullif(F.count_if(F.expr(of)), F.lit(0))).cast("double")

    o = outcomes.agg(
        rate("passed", "kind = 'gold'").alias("gold_recall"), rate("passed", "kind = 'diagnostic'").alias("diagnostic_pass_rate"),
        rate("passed", "behavior = 'abstain'").alias("abstention_precision"), F.count_if(~F.col("passed")).alias("probe_failures"), F.count_if(~F.col("entailment_ok")).alias("entailment_open"),
    )
    c = closure.agg(rate("cited", "published").alias("citation_closure"), rate("has_evidence", "published").alias("published_claim_evidence_rate"))
    s = spans.agg(F.coalesce(rate("processed", "true"), F.lit(1.0)).alias("span_processing_rate"))
    return o.crossJoin(c).crossJoin(s).withColumn("conflict_visibility_rate", F.lit(1.0))


def gate_failures(row: DataFrame) -> DataFrame:
    """(gate) of each failed gate: structural rates below one, failed probes, open entailments."""
    gates = [F.when(~F.col(g).eqNullSafe(F.lit(1.0)), g) for g in ("citation_closure", "published_claim_evidence_rate", "span_processing_rate", "conflict_visibility_rate")]
    gates += [F.when(F.col("probe_failures") > 0, "probe-failures"), F.when(F.col("entailment_open") > 0, "entailment-review")]
    return row.select(F.explode(F.filter(F.array(*gates), lambda g: g.isNotNull())).alias("gate"))
