"""Validator rules as violation tables.

Each rule is a DataFrame (rule_code, record_id, detail) of the rows that break it; a gate is open if
the union of its rules is empty. Set-based gates see every violation where a loop sees the first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import is_placeholder

#: Tiers whose claims carry the tier's own name as origin, a fixed value.
OWN_ORIGIN = ("derived-note", "user-authored", "unverified-local")


def violations(df: DataFrame, code: str, record: Column, when: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which ``when`` holds; null is no violation."""
    shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.where(F.coalesce(when, F.lit(False))).select(F.lit(code).alias("rule_code"), record.cast("string").alias("record_id"), shown.alias("detail"))


def violated(df: DataFrame, *rules: tuple) -> DataFrame:
    """``violations`` of several rules (code, record, when) or (code, record, when, detail) in one pass over df."""
    def row(code: str, record: Column, when: Column, detail: Column | None = None) -> Column:
        shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
        return F.when(when, F.struct(F.lit(code).alias("rule_code"), record.cast("string").alias("record_id"), shown.alias("detail")))

    found = F.filter(F.array(*(row(*r) for r in rules)), lambda r: r.isNotNull())
    return df.select(F.explode(found).alias("r")).select("r.*")


def union(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def is_open(rules: DataFrame) -> bool:
    """Whether nothing is violated; stops at the first row found."""
    return rules.isEmpty()


def duplicates(df: DataFrame, key: str, code: str = "DUPLICATE_ID") -> DataFrame:
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(twice, code, F.col(key), F.lit(True), F.col("n"))


def missing(refs: DataFrame, ref: str, known: DataFrame, key: str, code: str) -> DataFrame:
    """References without a target: an anti join, each missing key once."""
    keys = refs.select(F.col(ref).alias("k")).where("k IS NOT NULL").distinct()
    lost = keys.join(known.select(F.col(key).alias("k")), "k", "left_anti")
    return violations(lost, code, F.col("k"), F.lit(True))


def coverage(left: DataFrame, left_key: str, right: DataFrame, right_key: str, code: str) -> DataFrame:
    """Keys that one side has and the other lacks, with the side that has them."""
    a = left.select(F.col(left_key).alias("k")).distinct().withColumn("a", F.lit(True))
    b = right.select(F.col(right_key).alias("k")).distinct().withColumn("b", F.lit(True))
    both = a.join(b, "k", "full_outer")
    return violations(both, code, F.col("k"), F.col("a").isNull() | F.col("b").isNull(), F.when(F.col("b").isNull(), "left only").otherwise("right only"))


def set_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def unique_items(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether part is whole with some items left out, for arrays without repeats."""
    return F.filter(whole, lambda x: F.array_contains(part, x)) == part


def exact_keys(m: Column, *names: str) -> Column:
    return F.array_sort(F.map_keys(m)) == F.array(*(F.lit(n) for n in sorted(names)))


def claim_rules(claims: DataFrame) -> DataFrame:
    """Rules on the claim alone: substance, attribution, recommendation type, anchored support."""
    key = F.col("evidence_claim_id")
    return violated(
        claims,
        ("PLACEHOLDER_SEMANTICS", key, is_placeholder(F.col("predicate")), F.col("predicate")),
        ("MISSING_ATTRIBUTION", key, (F.col("modality") == "reported") & (F.coalesce("attribution", F.lit("")) == "")),
        ("MODALITY_TYPE_MISMATCH", key, (F.col("modality") == "recommended") & (F.col("claim_type") != "recommendation"), F.col("claim_type")),
        ("PRIMARY_EVIDENCE_REQUIRED", key, (F.col("primary_support_status") == "verified") & (F.size("primary_anchor_ids") == 0)),
    )


def provenance(claims: DataFrame, spans: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with their span, unit and source; the source is found by id and path together."""
    s = spans.select("evidence_span_id", F.col("content").alias("span_content"))
    u = units.select("evidence_unit_id", "source_id", "variant_path")
    r = sources.select("source_id", F.col("vault_relative_path").alias("variant_path"), "evidence_tier", "document_id", "work_id", "independence_group_id", "publisher_id")
    return claims.join(s, "evidence_span_id").join(u, "evidence_unit_id").join(r, ["source_id", "variant_path"])


def expected_origin(tier: Column) -> Column:
    return F.when(tier.isin(*OWN_ORIGIN), tier).otherwise("primary-source")


def evidence_rules(joined: DataFrame) -> DataFrame:
    """Rules on claims with their provenance: grounded excerpt and matching origin."""
    key = F.col("evidence_claim_id")
    origin = expected_origin(F.col("evidence_tier"))
    return violated(
        joined,
        ("UNGROUNDED_EXCERPT", key, ~F.col("span_content").contains(F.col("supporting_excerpt")), F.col("supporting_excerpt")),
        ("EVIDENCE_ORIGIN_MISMATCH", key, F.col("evidence_origin") != origin, origin),
    )


def review_rules(joined: DataFrame, reviews: DataFrame) -> DataFrame:
    """Primary-support reviews: one for each claim of a derived note, with its decision and anchors; none else."""
    r = reviews.select("evidence_claim_id", "decision", F.col("primary_anchor_ids").alias("reviewed"), F.lit(True).alias("there"))
    both = joined.join(r, "evidence_claim_id", "left")
    note, key = F.col("evidence_tier") == "derived-note", F.col("evidence_claim_id")
    return union(
        violations(both, "PRIMARY_REVIEW_REQUIRED", key, note & F.col("there").isNull()),
        violations(both, "PRIMARY_REVIEW_MISMATCH", key, note & F.col("there") & ((F.col("decision") != F.col("primary_support_status")) | ~set_equal(F.col("reviewed"), F.col("primary_anchor_ids")))),
        violations(both, "PRIMARY_EVIDENCE_REQUIRED", key, note & F.col("there") & F.col("decision").isin("verified", "partial") & (F.size("reviewed") == 0)),
        violations(both, "UNEXPECTED_PRIMARY_REVIEW", key, ~note & F.col("there")),
    )


def anchor_rules(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors that a claim names: known, and of its own unit."""
    named = claims.select("evidence_claim_id", "evidence_unit_id", F.explode("primary_anchor_ids").alias("primary_anchor_id"))
    known = anchors.select("primary_anchor_id", F.col("evidence_unit_id").alias("anchor_unit"))
    both = named.join(known, "primary_anchor_id", "left")
    return violations(both, "INVALID_PRIMARY_ANCHOR", F.col("evidence_claim_id"), F.col("anchor_unit").isNull() | (F.col("anchor_unit") != F.col("evidence_unit_id")), F.col("primary_anchor_id"))


def disposition_rules(spans: DataFrame, dispositions: DataFrame, claims: DataFrame) -> DataFrame:
    """Each span has one disposition: claims, or a reason for none; each claim is accounted for."""
    extracted = F.col("status") == "extracted"
    fits = F.when(extracted, (F.size("claim_ids") > 0) & F.col("reason").isNull()).otherwise((F.size("claim_ids") == 0) & F.col("reason").isNotNull())
    told = dispositions.select(F.explode("claim_ids").alias("evidence_claim_id"))
    return union(
        duplicates(dispositions, "evidence_span_id"),
        coverage(spans, "evidence_span_id", dispositions, "evidence_span_id", "INCOMPLETE_SPAN_COVERAGE"),
        violations(dispositions, "INVALID_SPAN_DISPOSITION", F.col("evidence_span_id"), ~fits, F.col("status")),
        missing(told, "evidence_claim_id", claims, "evidence_claim_id", "INVALID_DISPOSITION_REFERENCE"),
        missing(claims, "evidence_claim_id", told, "evidence_claim_id", "UNACCOUNTED_EVIDENCE_CLAIM"),
    )


def _substring(text: str, start: int, end: int) -> str:
    """What Spark's substring gives between two offsets, negative ones included."""
    low = len(text) + start + 1 if start < -1 else max(start, 0)
    return text[max(low, 0) : max(low + end - start, 0)]


def _span_faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, detail) from rows sorted by unit_id, units before their spans: one unit is held at a time."""
    unit, known = None, []  # of the unit: text, where its line ends are, first line
    for b in batches:
        keys, details = [], []
        for key, is_span, record, start, end, line, content, altered in zip(*(c.to_pylist() for c in b.columns)):
            if key != unit:
                unit, known = key, []
            content = None if content is None else content.decode("utf-8", "surrogateescape")
            if not is_span:
                known.append((content, [m.start() for m in re.finditer("\n", content or "")], line))
                continue
            for text, breaks, first in known or [(None, [], None)]:
                found = ["digest"] if altered else []
                if text is None:
                    found.append("text")
                elif start is not None:
                    if end is not None and content is not None and _substring(text, start, end) != content:
                        found.append("text")
                    if first is not None and line is not None and first + bisect_left(breaks, start) != line:
                        found.append("line")
                keys += [record] * len(found)
                details += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(details, pa.string())], names=["record_id", "detail"])


def span_rules(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Spans that their unit does not reproduce: text, digest and line from the offsets.

    Units and spans are sorted by unit, so that each text is read once, in time that grows with its length and
    not with length times spans. Spans without a unit's id are dealt to all tasks.
    """
    none = F.lit(None)
    given = spans.select(
        F.col("evidence_unit_id").alias("unit_id"), F.lit(True).alias("is_span"), F.col("evidence_span_id").cast("string").alias("record_id"),
        *(F.col(c).cast("long").alias(c) for c in ("start_offset", "end_offset", "start_line")),
        F.col("content").cast("binary").alias("content"), (F.sha2("content", 256) != F.col("content_sha256")).alias("altered"),
    )
    texts = units.where(F.col("evidence_unit_id").isNotNull()).select(
        F.col("evidence_unit_id").alias("unit_id"), F.lit(False).alias("is_span"), none.cast("string").alias("record_id"), none.cast("long").alias("start_offset"), none.cast("long").alias("end_offset"),
        F.col("start_line").cast("long").alias("start_line"), F.col("content").cast("binary").alias("content"), none.cast("boolean").alias("altered"),
    )
    dealt = texts.unionByName(given).repartition("unit_id", F.when(F.col("unit_id").isNull(), F.xxhash64("record_id")))
    found = dealt.sortWithinPartitions("unit_id", "is_span").mapInArrow(_span_faults, "record_id string, detail string")
    return found.select(F.lit("VERIFY_SPAN").alias("rule_code"), "record_id", "detail")


def unit_rules(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units that their source file does not reproduce: the lines they name and their digest."""
    both = units.join(files.select(F.col("path").alias("variant_path"), "markdown"), "variant_path", "left")
    lines = F.slice(F.split("markdown", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return union(
        violations(both, "VERIFY_LOCATOR", F.col("evidence_unit_id"), F.col("markdown").isNull() | (F.array_join(lines, "\n") != F.col("content")), F.lit("lines")),
        violations(both, "VERIFY_LOCATOR", F.col("evidence_unit_id"), F.sha2("content", 256) != F.col("content_sha256"), F.lit("digest")),
    )


def exploded(df: DataFrame, key: str, label: str, named: dict[str, str], *also: str) -> DataFrame:
    """(key, item, label) of every item of several array columns, in one pass; named: column to its label; also:
    further columns that each row keeps."""
    none = F.array().cast("array<string>")

    def items(column: str, name: str) -> Column:
        return F.transform(F.coalesce(F.col(column), none), lambda x: F.struct(x.alias("item"), F.lit(name).alias(label)))

    return df.select(key, *also, F.explode(F.concat(*(items(c, n) for c, n in named.items()))).alias("e")).select(key, "e.item", f"e.{label}", *also)


def evidence_edges(canonical: DataFrame, *also: str) -> DataFrame:
    """(canonical_claim_id, evidence_claim_id, side) of support and opposition, and further columns of the claim."""
    return exploded(canonical, "canonical_claim_id", "side", {"supporting": "supports", "opposing": "opposes"}, *also).withColumnRenamed("item", "evidence_claim_id")


def qualifier_rules(canonical: DataFrame, claims: DataFrame) -> DataFrame:
    """A canonical claim keeps time, scope and conditions of all its evidence, on either side."""
    own = canonical.select("canonical_claim_id", "supporting", "opposing", F.col("time").alias("c_time"), F.col("scope").alias("c_scope"), F.col("conditions").alias("c_conditions"))
    e = claims.select("evidence_claim_id", "time", "scope", "conditions")
    both = evidence_edges(own, "c_time", "c_scope", "c_conditions").join(e, "evidence_claim_id")
    lost = (
        (F.col("time").isNotNull() & ~F.col("time").eqNullSafe(F.col("c_time")))
        | (F.col("scope").isNotNull() & ~F.col("scope").eqNullSafe(F.col("c_scope")))
        | (F.size(F.array_except("conditions", "c_conditions")) > 0)
    )
    return violations(both, "QUALIFIER_LOSS", F.col("canonical_claim_id"), lost, F.col("evidence_claim_id"))


def canonical_rules(canonical: DataFrame, claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """Closure, contradiction, references both ways and supersession symmetry."""
    key = F.col("canonical_claim_id")
    edges = F.size("supporting") + F.size("opposing") + F.size("derived_from")
    concept_refs = canonical.select("canonical_claim_id", F.explode("concept_ids").alias("concept_id"))
    back = concepts.select("concept_id", F.explode("claim_ids").alias("canonical_claim_id"))
    unknown_back = concept_refs.join(concepts.select("concept_id"), "concept_id", "left_semi").join(back, ["canonical_claim_id", "concept_id"], "left_anti")
    undefined = concepts.select("concept_id", F.explode(F.array_except("definition_claim_ids", "claim_ids")).alias("canonical_claim_id"))
    newer = canonical.select(F.col("canonical_claim_id").alias("new"), F.explode("supersedes").alias("old"))
    older = canonical.select(F.explode("superseded_by").alias("new"), F.col("canonical_claim_id").alias("old"))
    uneven = union_pairs(newer.join(older, ["new", "old"], "left_anti"), older.join(newer, ["new", "old"], "left_anti"))
    return union(
        violations(canonical, "CONTRADICTORY_EDGE", key, F.arrays_overlap("supporting", "opposing")),
        violations(canonical, "EVIDENCE_CLOSURE", key, edges == 0),
        missing(evidence_edges(canonical), "evidence_claim_id", claims, "evidence_claim_id", "UNKNOWN_EVIDENCE_CLAIM"),
        missing(concept_refs, "concept_id", concepts, "concept_id", "UNKNOWN_CONCEPT"),
        missing(canonical.select(F.explode(F.concat("derived_from", "supersedes", "superseded_by")).alias("r")), "r", canonical, "canonical_claim_id", "UNKNOWN_CANONICAL_CLAIM"),
        violations(unknown_back, "INVALID_CONCEPT_BACKREF", key, F.lit(True), F.col("concept_id")),
        violations(undefined, "INVALID_CONCEPT_BACKREF", key, F.lit(True), F.col("concept_id")),
        violations(uneven, "SUPERSESSION_BACKREF", F.col("new"), F.lit(True), F.col("old")),
        qualifier_rules(canonical, claims),
    )


def union_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def decision_rules(candidates: DataFrame, decisions: DataFrame, canonical: DataFrame) -> DataFrame:
    """Alignment decisions against candidates and against where the canonical claims put both claims.

    Placement comes from two joins on evidence ids, so claims are compared within the canonical
    claims that hold them and never with all.
    """
    key = F.col("alignment_candidate_id")
    review = candidates.where(F.col("policy_decision") == "human-review")
    made = decisions.where(F.col("decision") != "defer")
    edges = evidence_edges(canonical)
    left = edges.select(F.col("evidence_claim_id").alias("left_claim_id"), "canonical_claim_id", F.col("side").alias("l"))
    right = edges.select(F.col("evidence_claim_id").alias("right_claim_id"), "canonical_claim_id", F.col("side").alias("r"))
    met = decisions.join(candidates, "alignment_candidate_id")
    placed = met.join(left, "left_claim_id").join(right, ["right_claim_id", "canonical_claim_id"]).groupBy("alignment_candidate_id").agg(F.max(F.col("l") == F.col("r")).alias("together"), F.max(F.col("l") != F.col("r")).alias("against"))
    told = met.join(placed, "alignment_candidate_id", "left").fillna(False, ["together", "against"])
    kind = F.col("decision")
    return union(
        missing(review, "alignment_candidate_id", made, "alignment_candidate_id", "ALIGNMENT_REVIEW_INCOMPLETE"),
        missing(decisions, "alignment_candidate_id", review, "alignment_candidate_id", "ALIGNMENT_REVIEW_INCOMPLETE"),
        violations(told, "INVALID_ALIGNMENT_DECISION", key, ((kind == "merge") & (F.col("candidate_relation") != "possibly-equivalent")) | ((kind == "conflict") & (F.col("candidate_relation") != "possibly-conflicting")), kind),
        violations(told, "ALIGNMENT_DECISION_DRIFT", key, ((kind == "merge") & ~F.col("together")) | ((kind == "conflict") & ~F.col("against")) | ((kind == "keep-separate") & (F.col("together") | F.col("against"))), kind),
    )


def partition_rules(candidates: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Each candidate is reviewed exactly once, and each side of the review keeps candidate order.

    candidates: (job, name, position); reviewed: (job, name, side, position).
    """
    from pyspark.sql import Window

    r = reviewed.select("job", "name", "side", F.col("position").alias("said"))
    both = candidates.select("job", "name", "position").join(r, ["job", "name"], "full_outer")
    counted = both.groupBy("job", "name").agg(F.count("said").alias("n"), F.count("position").alias("m"))
    before = F.lag("position").over(Window.partitionBy("job", "side").orderBy("said"))
    ordered = both.where("said IS NOT NULL AND position IS NOT NULL").withColumn("before", before)
    return union(
        violations(counted, "REVIEW_PARTITION", F.concat_ws("/", "job", "name"), (F.col("n") != 1) | (F.col("m") == 0), F.col("n")),
        violations(ordered, "REVIEW_ORDER", F.concat_ws("/", "job", "name"), F.col("position") < F.col("before"), F.col("side")),
    )


#: Stages of a build from which each command may run.
STAGES = {
    "evidence-claims": ("prepared", "evidence-validated"),
    "suggest-alignments": ("evidence-validated", "canonical-validated"),
    "canonical-claims": ("evidence-validated", "canonical-validated"),
    "pages": ("canonical-validated", "pages-validated"),
    "evaluate": ("pages-validated", "evaluation-passed", "evaluation-blocked"),
    "publish": ("evaluation-passed", "publish-failed"),
}


def stage_rules(requests: DataFrame) -> DataFrame:
    """Requests (job, command, stage) that the stage does not allow."""
    allowed = F.lit(False)
    for command, stages in STAGES.items():
        allowed = allowed | ((F.col("command") == command) & F.col("stage").isin(*stages))
    publish = F.col("command") == "publish"
    return union(
        violations(requests, "PUBLISH_GATE", F.col("job"), publish & ~allowed, F.col("stage")),
        violations(requests, "STAGE_GATE", F.col("job"), ~publish & ~allowed, F.concat_ws(" after ", "command", "stage")),
    )


def graph_rules(canonical: DataFrame) -> DataFrame:
    """Edges on cycles of derivation or of supersession; evidence has no way back, so only claims matter."""
    from factloom.operators import graph

    derived = canonical.select(F.explode("derived_from").alias("src"), F.col("canonical_claim_id").alias("dst"))
    both = ((derived, "PROVENANCE_CYCLE"), (graph.supersession_edges(canonical), "SUPERSESSION_CYCLE"))
    return union(*(violations(graph.cycle_edges(edges), code, F.col("src"), F.lit(True), F.col("dst")) for edges, code in both))


def probe_rules(probes: DataFrame, results: DataFrame, canonical: DataFrame) -> DataFrame:
    """Probes and their results: some, unique, one result each, about known claims."""
    required = probes.select(F.explode("required_claim_ids").alias("canonical_claim_id"))
    return union(
        violations(probes.agg(F.count("*").alias("n")), "NO_PROBES", F.lit("probes"), F.col("n") == 0),
        duplicates(probes, "probe_id"), duplicates(results, "probe_id"),
        coverage(probes, "probe_id", results, "probe_id", "INCOMPLETE_PROBE_RESULTS"),
        missing(required, "canonical_claim_id", canonical, "canonical_claim_id", "UNKNOWN_CANONICAL_CLAIM"),
    )
