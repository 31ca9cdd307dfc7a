"""Pages of a knowledge base against their plan, the canonical claims and the front matter that they owe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import segment, support
from factloom.operators.rules import missing, set_equal, union, violated, violations
from factloom.session import spread, stored
from factloom.sources.markdown import front_matter

#: Sections that a page of a type must have, fixed values.
SECTIONS = {"concept": ("核心主张", "前提与局限", "开放问题", "证据"), "comparison": ("比较结论", "适用边界", "开放问题", "证据")}
#: Keys of a page's front matter, fixed values.
KEYS = ("knowledge_base", "page_id", "page_type", "build_id", "epistemic_summary")


def parsed(pages: DataFrame) -> DataFrame:
    """(path, markdown, metadata, body, main, evidence, cited, defined, headings) of (path, markdown)."""
    read = pages.select("path", "markdown", front_matter("markdown").alias("f")).select("path", "markdown", F.col("f.metadata").alias("metadata"), F.coalesce("f.body", F.lit("")).alias("body"))
    main, evidence = text.evidence_parts(F.col("body"))
    cut = read.select("*", main.alias("main"), evidence.alias("evidence"))
    headings = F.regexp_extract_all("body", F.lit(r"(?m)^#{2,6}\s+(.*?)\s*$"), F.lit(1))
    return cut.select("*", F.array_distinct(text.citations(F.col("markdown"))).alias("cited"), F.array_distinct(text.definitions(F.col("evidence"))).alias("defined"), headings.alias("headings"))


def front_matter_rules(planned: DataFrame, claims: DataFrame, knowledge_base: str, build_id: str) -> DataFrame:
    """Front matter of planned pages: exactly its keys, with the values of the plan and the counts of their claims.

    planned: ``parsed`` pages with page_id, page_type and claim_ids; claims: (canonical_claim_id, status).
    """
    value = lambda k: F.get_json_object("metadata", f"$.{k}")
    wanted = {"knowledge_base": F.lit(knowledge_base), "page_id": F.col("page_id"), "page_type": F.col("page_type"), "build_id": F.lit(build_id)}
    keys = F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>"))
    wrong = F.filter(F.array(*(F.when(~value(k).eqNullSafe(v), k) for k, v in wanted.items())), lambda k: k.isNotNull())
    rows = planned.select("path", (~set_equal(keys, F.array(*map(F.lit, KEYS)))).alias("odd"), F.array_join(wrong, ",").alias("wrong"))
    counted = support.status_pivot(planned.select("page_id", "claim_ids"), claims)
    due = counted.select("page_id", F.array(*(F.struct(F.lit(s).alias("key"), F.col(f"`{s}`").alias("value")) for s in sorted(support.STATUSES))).alias("due"))
    shown = F.array_sort(F.map_entries(F.from_json(value("epistemic_summary"), "map<string,bigint>")))
    both = planned.select("path", "page_id", shown.alias("shown")).join(due, "page_id")
    return union(
        violated(
            rows,
            ("INVALID_PAGE_FRONTMATTER", F.col("path"), F.col("odd"), F.lit("keys")),
            ("INVALID_PAGE_FRONTMATTER", F.col("path"), ~F.col("odd") & (F.col("wrong") != ""), F.col("wrong")),
        ),
        violations(both, "INVALID_PAGE_STATUS", F.col("path"), ~F.col("shown").eqNullSafe(F.col("due"))),
    )


def content_rules(planned: DataFrame, claims: DataFrame) -> DataFrame:
    """Bodies of planned pages: safe content, closed citations, sections, cited blocks, visible statuses."""
    key, kind = F.col("path"), F.col("page_type")
    need = F.when(kind == "concept", F.array(*map(F.lit, SECTIONS["concept"]))).when(kind == "comparison", F.array(*map(F.lit, SECTIONS["comparison"])))
    lost = F.array_join(F.array_sort(F.array_except(need, "headings")), ",")
    unsafe = F.col("markdown").rlike(text.REMOTE_IMAGE) | F.col("markdown").rlike(text.ABSOLUTE_PATH)
    blocks = segment.factual_blocks(planned.where(kind.isin(*SECTIONS)), "path", "body")
    return union(
        violated(
            planned,
            ("UNSAFE_PAGE_CONTENT", key, unsafe),
            ("PAGE_CITATION_CLOSURE", key, ~set_equal(F.col("cited"), F.col("claim_ids")) | ~set_equal(F.col("defined"), F.col("cited"))),
            ("MISSING_PAGE_SECTION", key, lost != "", lost),
        ),
        violations(blocks, "UNCITED_FACTUAL_BLOCK", F.col("page_id"), ~F.col("text").rlike(text.CITATION), F.substring("text", 1, 200)),
        support.hidden_status(planned.select("page_id", "main", "claim_ids"), claims),
    )


def page_rules(pages: DataFrame, plan: DataFrame, claims: DataFrame, concepts: DataFrame, knowledge_base: str, build_id: str) -> DataFrame:
    """All rules on pages (path, markdown) of a plan (page_id, page_type, path, claim_ids, concept_ids).

    claims: (canonical_claim_id, status), each of which some page must hold.
    """
    planned = plan.join(stored(parsed(spread(pages))), "path")
    named = plan.select(F.explode("claim_ids").alias("canonical_claim_id"))
    index = pages.where("path = 'index.md'").select(F.col("markdown").alias("text"))
    return union(
        support.page_plan_rules(plan, pages.select("path"), concepts, index),
        missing(named, "canonical_claim_id", claims, "canonical_claim_id", "UNKNOWN_CANONICAL_CLAIM"),
        missing(plan.select(F.explode("concept_ids").alias("concept_id")), "concept_id", concepts, "concept_id", "UNKNOWN_CONCEPT"),
        front_matter_rules(planned, claims, knowledge_base, build_id),
        content_rules(planned, claims),
        missing(claims, "canonical_claim_id", named, "canonical_claim_id", "PUBLISHED_CLAIM_COVERAGE"),
    )


def page_records(pages: DataFrame, plan: DataFrame, claims: DataFrame) -> DataFrame:
    """The plan's pages with the count of each status and the digest of their text."""
    counts = support.status_pivot(plan, claims)
    summary = F.map_from_arrays(F.array(*map(F.lit, support.STATUSES)), F.array(*(F.col(f"`{s}`") for s in support.STATUSES)))
    digests = pages.select("path", F.sha2("markdown", 256).alias("content_sha256"))
    return plan.join(counts.select("page_id", summary.alias("epistemic_summary")), "page_id").join(digests, "path")
