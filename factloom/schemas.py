"""The records of a knowledge base: columns, types and constraints, declared once as text.

A line is ``column type rule rule ...``. Types are string, long, double, boolean, strings (an array
of strings) and struct<...> or array<...> in DDL. A type with ? may be null. Rules:

    id:p        p_ and 12 to 64 hex digits      name:p      p_ and a short name
    hex64       a SHA-256                        in:a|b      one of the values (arrays: each item)
    ge:n        at least n                       le:n        at most n
    len:a..b    text length, or array size       unique      an array without repeats

``schema`` gives the Spark type, ``violations`` the rows that break a rule. Version 2 of the schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
_CLAIM_TYPES = "definition|mechanism|result|comparison|recommendation|limitation|prediction|observation"
_QUALIFIERS = "struct<time:string,scope:string,conditions:array<string>>"
_REVIEWER = """
    reviewer_type           string   in:human|codex
    reviewer_id             string   len:1..200
    rationale               string   len:8..2000
"""

RECORDS = {
    "sources": """
    source_id               string   id:src
    vault_relative_path     string
    content_sha256          string   hex64
    byte_size               long     ge:0
    source_url              string?
    title                   string
    published               string?
    source_kind             string   in:collected-article|faithful-translation|course-note|user-note|unknown-markdown
    evidence_tier           string   in:local-source-snapshot|faithful-variant|derived-note|user-authored|unverified-local
    document_id             string   id:document
    work_id                 string   id:work
    corpus_id               string   id:corpus
    publisher_id            string   id:publisher
    independence_group_id   string   id:independence
    variant_group_id        string   id:variant
    variant_role            string   in:original|translation|duplicate|sole
    verification            struct<validator:string,status:string,details:string>
""",
    "evidence_units": """
    evidence_unit_id        string   id:eu
    source_id               string   id:src
    variant_path            string
    heading_path            strings
    start_line              long     ge:1
    end_line                long     ge:1
    content_sha256          string   hex64
    content                 string
    upstream_locators       array<struct<type:string,value:string>>
""",
    "evidence_spans": """
    evidence_span_id        string   id:es
    evidence_unit_id        string   id:eu
    start_offset            long     ge:0
    end_offset              long     ge:1
    start_line              long     ge:1
    end_line                long     ge:1
    content_sha256          string   hex64
    content                 string   len:1..
    span_kind               string   in:prose|list-item|table-row|media|code|link|other
""",
    "primary_anchors": """
    primary_anchor_id       string   id:pa
    source_id               string   id:src
    evidence_unit_id        string   id:eu
    anchor_type             string   in:video-timestamp|source-location
    locator                 string
    local_asset_path        string?
    local_asset_sha256      string?  hex64
    verification_status     string   in:available|unavailable
""",
    "evidence_claims": f"""
    evidence_claim_id       string   name:ec
    evidence_unit_id        string   id:eu
    evidence_span_id        string   id:es
    statement               string   len:1..4000
    claim_type              string   in:{_CLAIM_TYPES}
    polarity                string   in:positive|negative|mixed
    modality                string   in:asserted|reported|recommended|hypothesized|uncertain
    subject                 string   len:1..500
    predicate               string   len:1..500
    object                  string   len:1..2000
    qualifiers              {_QUALIFIERS}
    attribution             string?
    evidence_origin         string   in:primary-source|derived-note|user-authored|unverified-local
    primary_anchor_ids      strings  unique
    primary_support_status  string?  in:verified|partial|unavailable
    extraction_status       string   in:supported
    supporting_excerpt      string   len:1..500
    supporting_excerpt_hash string?  hex64
""",
    "span_dispositions": """
    evidence_span_id        string   id:es
    evidence_unit_id        string   id:eu
    status                  string   in:extracted|no-claim
    claim_ids               strings  unique
    reason                  string?  in:navigation|duplicate|format-only|out-of-scope|insufficient-content|supporting-context
""",
    "primary_support_reviews": f"""
    review_id               string   id:psr
    evidence_claim_id       string   name:ec
    primary_anchor_ids      strings  unique
    decision                string   in:verified|partial|unavailable
    {_REVIEWER}
""",
    "canonical_claims": f"""
    canonical_claim_id      string   name:cc
    statement               string   len:1..6000
    concept_ids             strings  len:1.. unique
    claim_type              string   in:{_CLAIM_TYPES}
    qualifiers              {_QUALIFIERS}
    supporting_evidence_claim_ids strings unique
    opposing_evidence_claim_ids strings unique
    derived_from_claim_ids  strings  unique
    document_support_count  long?    ge:0
    work_support_count      long?    ge:0
    independent_source_count long?   ge:0
    publisher_count         long?    ge:0
    epistemic_status        string?  in:single-source|multi-source|disputed|superseded|derived|derived-note-only|insufficient-evidence
    supersedes              strings  unique
    superseded_by           strings  unique
    user_decision_id        string?
""",
    "concepts": """
    concept_id              string   name:concept
    preferred_label         string   len:1..500
    aliases                 strings  unique
    definition_claim_ids    strings  unique
    claim_ids               strings  unique
    related_concept_ids     strings  unique
    relation_types          strings  in:is-a|part-of|depends-on|enables|contrasts-with|related-to|supersedes
    status                  string   in:active|deprecated
""",
    "alignment_candidates": """
    alignment_candidate_id  string   id:align
    left_claim_id           string
    right_claim_id          string
    candidate_relation      string   in:possibly-equivalent|possibly-conflicting|related
    signals                 struct<lexical_similarity:double,entity_compatible:boolean,polarity_compatible:boolean,temporal_compatible:boolean,qualifier_compatible:boolean,embedding_similarity:double,nli_label:string,llm_judgement:string>
    generator_ids           strings  len:1..
    policy_decision         string   in:keep-separate|human-review|merge-approved
    decision_reasons        strings  len:1..
""",
    "alignment_decisions": f"""
    alignment_candidate_id  string   id:align
    decision                string   in:keep-separate|merge|conflict|related|defer
    {_REVIEWER}
""",
    "algorithm_runs": """
    run_id                  string   id:run
    algorithm_id            string
    algorithm_version       string
    parameters_sha256       string   hex64
    input_sha256            string   hex64
    output_sha256           string   hex64
    random_seed             long
    model_id                string?
    elapsed_ms              long     ge:0
    status                  string   in:passed|failed
""",
    "page_plan": """
    page_id                 string   slug
    page_type               string   in:concept|comparison|map|question
    path                    string
    title                   string   len:1..
    claim_ids               strings  unique
    concept_ids             strings  unique
""",
    "probes": """
    probe_id                string   name:probe
    kind                    string   in:gold|diagnostic
    question                string   len:1..
    expected_behavior       string   in:answer|abstain
    required_claim_ids      strings  unique
    author_type             string   in:human|codex
    author_id               string   len:1..200
    rationale               string   len:8..2000
""",
    "probe_results": f"""
    probe_id                string
    behavior                string   in:answer|abstain
    answer                  string   len:1..
    cited_claim_ids         strings  unique
    entailment_status       string   in:verified|not-reviewed|failed
    {_REVIEWER}
""",
    "evaluation_report": """
    schema_version          long     ge:2 le:2
    status                  string   in:passed|blocked
    evaluation_level        string   in:diagnostic-only|gold-reviewed
    metrics                 map<string,double>
    counts                  map<string,bigint>
    failed_probe_ids        strings
    gate_failures           strings
""",
    "transcript_cues": """
    video_id                string
    start                   double   ge:0
    end                     double   ge:0
    text                    string   len:1..
""",
    "slide_segments": """
    video_id                string
    id                      string   len:1..
    start_seconds           double   ge:0
    end_seconds             double   ge:0
    sample_count            long     ge:2
    representatives         array<struct<quality:double,rank_score:double,timestamp:double>> len:1..3
""",
    "image_assets": """
    path                    string   len:1..
    mime_type               string   in:image/jpeg|image/png|image/gif|image/webp|image/avif|image/svg+xml
    sha256                  string   hex64
""",
}

#: Rules over several columns of one record, as SQL that holds for a right one.
ACROSS = {
    "evidence_units": ["end_line >= start_line", "forall(upstream_locators, x -> x.type IN ('url', 'timestamp'))"],
    "evidence_spans": ["end_offset > start_offset", "end_line >= start_line"],
    "sources": ["verification.status IN ('passed', 'unverified-local')"],
    "span_dispositions": ["if(status = 'extracted', size(claim_ids) > 0 AND reason IS NULL, size(claim_ids) = 0 AND reason IS NOT NULL)"],
    "concepts": ["size(related_concept_ids) = size(relation_types)"],
    "alignment_candidates": ["signals.lexical_similarity BETWEEN 0 AND 1", "coalesce(signals.embedding_similarity BETWEEN 0 AND 1, true)"],
    "probes": ["kind != 'gold' OR author_type = 'human'"],
    "transcript_cues": ["end >= start"],
    "slide_segments": ["end_seconds >= start_seconds"],
}
_TYPES = {"string": "string", "long": "bigint", "double": "double", "boolean": "boolean", "strings": "array<string>"}


def columns(name: str) -> list[tuple[str, str, bool, list[str]]]:
    """(column, DDL type, nullable, rules) of a record."""
    out = []
    for line in RECORDS[name].strip().splitlines():
        if line.strip():
            column, kind, *rules = line.split()
            out.append((column, _TYPES.get(kind.rstrip("?"), kind.rstrip("?")), kind.endswith("?"), rules))
    return out


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.DataType.fromDDL(kind), nullable) for c, kind, nullable, _ in columns(name)])


def _holds(col: Column, is_array: bool, rule: str) -> Column:
    key, _, arg = rule.partition(":")
    if key == "id":
        return col.rlike(rf"^{arg}_[a-f0-9]{{12,64}}$")
    if key == "name":
        return col.rlike(rf"^{arg}_[a-z0-9][a-z0-9_-]{{2,{100 if arg in ('concept', 'probe') else 80}}}$")
    if key == "slug":
        return col.rlike(r"^[a-z0-9][a-z0-9_-]{2,100}$")
    if key == "hex64":
        return col.rlike(r"^[a-f0-9]{64}$")
    if key == "in":
        return F.forall(col, lambda x: x.isin(*arg.split("|"))) if is_array else col.isin(*arg.split("|"))
    if key == "ge":
        return col >= int(arg)
    if key == "le":
        return col <= int(arg)
    if key == "len":
        low, high = arg.split("..")
        size = F.size(col) if is_array else F.length(col)
        return (size >= int(low)) & (size <= int(high)) if high else size >= int(low)
    if key == "unique":
        return F.size(F.array_distinct(col)) == F.size(col)
    raise ValueError(f"unknown rule {rule}")


def violations(name: str, df: DataFrame) -> DataFrame:
    """(rule_code, record_id, detail) of each rule that a row breaks; the first column names the row.

    All rules are columns of one pass over df; rows without a broken rule are gone before any shuffle.
    """
    cols = columns(name)
    broken = []
    for c, kind, nullable, rules in cols:
        col = F.col(f"`{c}`")
        if not nullable:
            broken.append(F.when(col.isNull(), f"{c}: null"))
        broken += [F.when(~_holds(col, kind.startswith("array"), r), f"{c}: {r}") for r in rules]
    broken += [F.when(~F.coalesce(F.expr(rule), F.lit(False)), rule) for rule in ACROSS.get(name, ())]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return df.select(F.lit("INVALID_IR").alias("rule_code"), F.col(cols[0][0]).cast("string").alias("record_id"), F.explode(found).alias("detail"))


def missing_or_extra(name: str, df: DataFrame) -> list[str]:
    """Columns that the record has and df lacks, the other way round, or with another type."""
    want = {f.name: f.dataType.simpleString() for f in schema(name)}
    have = dict(df.dtypes)
    return sorted([f"missing {c}" for c in want.keys() - have.keys()] + [f"unknown {c}" for c in have.keys() - want.keys()] + [f"type of {c}" for c in want.keys() & have.keys() if want[c] != have[c]])


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def names() -> list[str]:
    return sorted(RECORDS)


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of several tables."""
    return reduce(DataFrame.unionByName, [violations(n, df) for n, df in tables.items()])
