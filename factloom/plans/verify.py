"""Independent verification of a published build.

It recomputes from the published tables and the source files and shares only hashing and text
functions with the build: no gate, segmenter or rule of the build is imported here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import stable_id


def _found(df: DataFrame, code: str, key: str, when) -> DataFrame:
    return df.where(F.coalesce(when, F.lit(True))).select(F.lit(code).alias("rule_code"), F.col(key).cast("string").alias("record_id"), F.lit(None).cast("string").alias("detail"))


def _claims(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Excerpts and dispositions of claims."""
    claims, spans, told = t["evidence_claims"], t["evidence_spans"], t["span_dispositions"]
    held = claims.join(spans.select("evidence_span_id", F.col("content").alias("said")), "evidence_span_id", "left")
    named = told.select("evidence_span_id", F.explode("claim_ids").alias("evidence_claim_id")).join(claims.select("evidence_claim_id", F.col("evidence_span_id").alias("own")), "evidence_claim_id", "full_outer")
    both = spans.select("evidence_span_id", F.lit(1).alias("a")).join(told.select("evidence_span_id", F.lit(1).alias("b")), "evidence_span_id", "full_outer")
    return [
        _found(held, "VERIFY_EXCERPT", "evidence_claim_id", F.col("said").isNull() | ~F.col("said").contains(F.col("supporting_excerpt"))),
        _found(named, "VERIFY_DISPOSITION", "evidence_claim_id", ~F.col("evidence_span_id").eqNullSafe(F.col("own"))),
        _found(both, "VERIFY_SPAN_COVERAGE", "evidence_span_id", F.col("a").isNull() | F.col("b").isNull()),
        _found(claims.groupBy("evidence_claim_id").count().where("count > 1"), "VERIFY_DUPLICATE_ID", "evidence_claim_id", F.lit(True)),
    ]


def _canonical(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Counts and statuses of canonical claims, from their evidence's sources."""
    k = t["canonical_status"]
    edges = k.select("canonical_claim_id", F.explode(F.array_union("supporting", "opposing")).alias("evidence_claim_id"))
    units, src = t["evidence_units"].select("evidence_unit_id", "source_id", "variant_path"), t["sources"].select("source_id", F.col("path").alias("variant_path"), "document_id", "work_id", "independence_group_id", "publisher_id")
    of = t["evidence_claims"].select("evidence_claim_id", "evidence_unit_id", (F.col("evidence_origin") == "derived-note").alias("note"), F.col("primary_support_status").eqNullSafe(F.lit("verified")).alias("verified"))
    met = edges.join(of, "evidence_claim_id").join(units, "evidence_unit_id").join(src, ["source_id", "variant_path"])
    sums = met.groupBy("canonical_claim_id").agg(*(F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(("document_id", "work_id", "independence_group_id", "publisher_id"))), F.min("note").alias("notes"), F.min("verified").alias("sure"))
    both = k.join(sums, "canonical_claim_id", "left")
    wrong = reduce(lambda a, b: a | b, (F.coalesce(f"n{i}", F.lit(0)) != F.col(c) for i, c in enumerate(("document_count", "work_count", "independent_count", "publisher_count"))))
    opposed, parents, backed = F.size("opposing") > 0, F.size("derived_from") > 0, F.size("supporting") > 0
    due = (
        F.when(F.size("superseded_by") > 0, "superseded").when(opposed, "disputed").when(parents & ~backed, "derived").when(F.col("notes") & ~F.col("sure"), "derived-note-only")
        .when(F.col("n2") > 1, "multi-source").when(F.col("n2") == 1, "single-source").otherwise("insufficient-evidence")
    )
    return [_found(both, "VERIFY_COUNTS", "canonical_claim_id", wrong), _found(both, "VERIFY_STATUS", "canonical_claim_id", due != F.col("status"))]


def _pages(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Digests, citations and claims of pages."""
    held = t["page_records"].join(t["pages"].select("path", "markdown"), "path", "full_outer")
    cited = F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"\[\^(cc_[a-z0-9][a-z0-9_-]{2,80})\]"), F.lit(1)))
    shown = t["page_records"].select(F.explode("claim_ids").alias("canonical_claim_id")).distinct()
    lost = t["canonical_status"].join(shown, "canonical_claim_id", "left_anti")
    return [
        _found(held, "VERIFY_PAGE", "path", ~F.sha2("markdown", 256).eqNullSafe(F.col("content_sha256"))),
        _found(held, "VERIFY_PAGE", "path", (F.size(F.array_except(cited, "claim_ids")) > 0) | (F.size(F.array_except("claim_ids", cited)) > 0)),
        _found(lost, "VERIFY_PAGE", "canonical_claim_id", F.lit(True)),
    ]


def verify_tables(t: dict[str, DataFrame]) -> DataFrame:
    """Violations: ids, digests, lines and offsets that the tables do not reproduce; of claims, canonical
    claims and pages, if they are there, also excerpts, counts, statuses and citations."""
    sources, units, spans, files = (t[n] for n in ("sources", "evidence_units", "evidence_spans", "files"))
    held = sources.select("path", "content_sha256").join(files, "path", "full_outer")
    cut = units.join(files.withColumnRenamed("path", "variant_path"), "variant_path", "left").withColumn("lines", F.split("markdown", "\n", -1))
    own = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    unit_id = stable_id("eu", F.col("source_id"), F.col("variant_path"), F.col("start_line"), F.col("end_line"), F.sha2("content", 256))
    of = units.select("evidence_unit_id", F.col("content").alias("unit"), F.col("start_line").alias("first"))
    met = spans.join(of, "evidence_unit_id", "left")
    head = F.substring("unit", F.lit(1), F.col("start_offset"))
    span_id = stable_id("es", F.col("evidence_unit_id"), F.col("start_offset"), F.col("end_offset"), F.sha2("content", 256))
    bare = F.regexp_replace(F.regexp_replace("unit", r"(?m)^\s*(?:(?:[-+*]|\d+[.)])\s+)?", ""), r"\s+", "")
    said = spans.groupBy("evidence_unit_id").agg(F.sum(F.length(F.regexp_replace("content", r"\s+", ""))).alias("n"))
    covered = of.join(said, "evidence_unit_id", "left").withColumn("whole", F.length(bare))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    parts = [
        _found(held, "VERIFY_SOURCE_CHANGED", "path", ~F.sha2("markdown", 256).eqNullSafe(F.col("content_sha256"))),
        _found(cut, "VERIFY_LOCATOR", "evidence_unit_id", ~own.eqNullSafe(F.col("content"))),
        _found(cut, "VERIFY_PROVENANCE", "evidence_unit_id", (F.sha2("content", 256) != F.col("content_sha256")) | (unit_id != F.col("evidence_unit_id"))),
        _found(met, "VERIFY_SPAN", "evidence_span_id", ~F.substring("unit", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")).eqNullSafe(F.col("content"))),
        _found(met, "VERIFY_SPAN", "evidence_span_id", (F.sha2("content", 256) != F.col("content_sha256")) | (span_id != F.col("evidence_span_id"))),
        _found(met, "VERIFY_SPAN", "evidence_span_id", F.col("first") + F.length(F.regexp_replace(head, r"[^\n]", "")) != F.col("start_line")),
        _found(covered, "VERIFY_SPAN_COVERAGE", "evidence_unit_id", F.coalesce("n", F.lit(0)) != F.col("whole")),
        _found(twice(units, "evidence_unit_id"), "VERIFY_DUPLICATE_ID", "evidence_unit_id", F.lit(True)),
        _found(twice(spans, "evidence_span_id"), "VERIFY_DUPLICATE_ID", "evidence_span_id", F.lit(True)),
    ]
    for more, needs in ((_claims, {"evidence_claims", "span_dispositions"}), (_canonical, {"evidence_claims", "canonical_status"}), (_pages, {"pages", "page_records", "canonical_status"})):
        if needs <= t.keys():
            parts += more(t)
    return reduce(DataFrame.unionByName, parts)
