"""Records for the operators, derived from the driver's tables, in Spark and in DuckDB's SQL.

The tables hold no Markdown, claims or video, so documents stand for sources, their sentences for
spans and claims, and event values for frames of one pixel. Both forms derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.hashing import stable_id
from factloom.operators import segment
from factloom.session import spread, stored, table

NEGATORS = ("not", "no", "nicht", "kein", "pas", "non")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), F.col("doc_id"), F.lit(".md"))
    return d.select(
        "doc_id", stable_id("src", path).alias("source_id"), path.alias("path"), F.concat(F.lit("https://t.example/"), F.substring(F.sha2("text", 256), 1, 16)).alias("source_url"),
        F.when(F.col("lang") == "en", "user-note").otherwise("faithful-translation").alias("source_kind"), F.col("source").alias("author"), "lang", "text",
        F.sha2("text", 256).alias("content_sha256"), F.octet_length("text").cast("long").alias("byte_size"),
    )


def repeated(spark: SparkSession, sf_dir: str) -> bool:
    """Whether documents have an id in common, so that an id does not name one text."""
    return not table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def spans(spark: SparkSession, sf_dir: str, *also: str, shared_ids: bool | None = None) -> DataFrame:
    """(doc_id, start_offset, end_offset, line, content, span_kind) and what ``also`` names of the documents with the
    span's id: of the text's own row, or, if ids repeat, of all rows with its id. shared_ids: what ``repeated`` found."""
    docs = table(spark, sf_dir, "documents")
    if not also:
        d = spread(docs.select("doc_id", "text"))
    elif repeated(spark, sf_dir) if shared_ids is None else shared_ids:
        d = spread(docs.select("doc_id", "text")).join(docs.select("doc_id", *also), "doc_id")
    else:
        d = spread(docs.where("doc_id IS NOT NULL").select("doc_id", "text", *also))
    return segment.span_rows(d, "doc_id", "text", F.lit(1), *also).withColumnRenamed("evidence_unit_id", "doc_id")


def claims(spark: SparkSession, sf_dir: str, shared_ids: bool | None = None) -> DataFrame:
    """Every sentence as a claim: subject its first two words, predicate the third."""
    words = F.filter(F.split("statement", " "), lambda x: x != "")
    negated = F.exists(words, lambda w: F.lower(w).isin(*NEGATORS))
    return spans(spark, sf_dir, "lang", "source", shared_ids=shared_ids).withColumnRenamed("content", "statement").select(
        F.concat_ws("-", F.lit("ec"), "doc_id", "start_offset").alias("evidence_claim_id"), "doc_id", "line", "statement",
        F.array_join(F.slice(words, 1, 2), " ").alias("subject"), F.coalesce(F.get(words, F.lit(2)), F.lit("is")).alias("predicate"),
        F.when(negated, "negative").otherwise("positive").alias("polarity"), F.col("lang").alias("scope"), "source",
        F.when(F.pmod("line", F.lit(5)) == 0, "reported").when(F.pmod("line", F.lit(7)) == 0, "recommended").otherwise("asserted").alias("modality"),
        F.when(F.pmod("line", F.lit(7)) == 0, F.when(F.pmod("doc_id", F.lit(2)) == 0, "recommendation").otherwise("fact")).otherwise("fact").alias("claim_type"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("source")).alias("attribution"),
    )


def canonical_id(statement: str = "statement"):
    return F.concat(F.lit("cc_"), F.substring(F.sha2(statement, 256), 1, 12))


def canonical(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Claims of one statement together; opposing where the document's number is odd. found: the stored claims,
    if there are any. Stored, as operators read canonical claims several times."""
    c = claims(spark, sf_dir) if found is None else found
    odd = F.pmod("doc_id", F.lit(2)) == 1
    # the hash comes first, as statements that begin alike are slow to sort
    return stored(c.groupBy(F.xxhash64("statement").alias("h"), "statement").agg(
        F.sort_array(F.collect_list(F.when(~odd, F.col("evidence_claim_id")))).alias("supporting"),
        F.sort_array(F.collect_list(F.when(odd, F.col("evidence_claim_id")))).alias("opposing"),
    ).select(
        canonical_id().alias("canonical_claim_id"), "statement", "supporting", "opposing",
        F.when(F.col("statement").rlike("^[A-D]"), F.array(F.lit("cc_parent"))).otherwise(F.array().cast("array<string>")).alias("derived_from"),
        F.when(F.col("statement").rlike("^[XYZ]"), F.array(F.lit("cc_newer"))).otherwise(F.array().cast("array<string>")).alias("superseded_by"),
    ))


def canonical_counts(found: DataFrame) -> DataFrame:
    """Canonical claims as ``canonical`` makes them, with the numbers of claims on either side and not their lists.
    found: (canonical_claim_id, statement, doc_id) of stored claims."""
    odd = F.pmod("doc_id", F.lit(2)) == 1
    none = F.array().cast("array<string>")
    return found.groupBy(F.xxhash64("statement").alias("h"), "statement", "canonical_claim_id").agg(
        F.count_if(~odd).alias("supporting_count"), F.count_if(odd).alias("opposing_count"),
    ).select(
        "canonical_claim_id", "supporting_count", "opposing_count",
        F.when(F.col("statement").rlike("^[A-D]"), F.array(F.lit("cc_parent"))).otherwise(none).alias("derived_from"),
        F.when(F.col("statement").rlike("^[XYZ]"), F.array(F.lit("cc_newer"))).otherwise(none).alias("superseded_by"),
    )


def stated():
    """What ``statement`` alone says of its canonical claim: its digest, of which the id is the first 12 digits, and whether
    the claim is derived or superseded."""
    first = F.substring("statement", 1, 1)
    return F.unhex(F.sha2("statement", 256)).alias("statement_id"), first.isin(*"ABCD").alias("derived"), first.isin(*"XYZ").alias("superseded")


SOURCES_SQL = """src AS (
  SELECT doc_id, 'src_' || substr(sha256('documents/' || doc_id || '.md'), 1, 20) AS source_id, 'documents/' || doc_id || '.md' AS path,
         'https://t.example/' || substr(sha256(text), 1, 16) AS source_url, CASE WHEN lang = 'en' THEN 'user-note' ELSE 'faithful-translation' END AS source_kind,
         source AS author, lang, text, sha256(text) AS content_sha256, octet_length(encode(text)) AS byte_size FROM documents
)"""

SPANS_SQL = r"""line AS (
  SELECT doc_id, i AS line, l[i] AS raw, coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS line_at
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
), marked AS (
  SELECT doc_id, line, line_at, raw, regexp_replace(raw, '^\s+', '') AS bare, regexp_extract(regexp_replace(raw, '^\s+', ''), '^(?:[-+*]|\d+[.)])\s+') AS prefix FROM line
), cut AS (
  SELECT *, substr(bare, length(prefix) + 1) AS body, line_at + length(raw) - length(bare) + length(prefix) AS body_at FROM marked
), kinded AS (
  SELECT *, CASE WHEN starts_with(body, '![') THEN 'media' WHEN starts_with(body, '[') AND contains(body, '](') THEN 'link'
                 WHEN starts_with(body, '```') OR starts_with(body, '~~~') OR (starts_with(raw, '    ') AND prefix = '') THEN 'code'
                 WHEN length(body) - length(replace(body, '|', '')) >= 2 THEN 'table-row' WHEN prefix <> '' THEN 'list-item' ELSE 'prose' END AS span_kind,
         string_split(regexp_replace(regexp_replace(body, '([。！？；])', '\1' || chr(30), 'g'), '([.!?])(\s|$)', '\1' || chr(30) || '\2', 'g'), chr(30)) AS p FROM cut
), piece AS (
  SELECT doc_id, line, span_kind, p[j] AS piece, body_at + coalesce(list_sum(list_transform(p[1:j-1], lambda x: length(x))), 0) AS piece_at
  FROM (SELECT *, unnest(generate_series(1, len(p))) AS j FROM kinded)
), span AS (
  SELECT doc_id, CAST(piece_at + length(piece) - length(ltrim(piece)) AS BIGINT) AS start_offset,
         CAST(piece_at + length(piece) - length(ltrim(piece)) + length(trim(piece)) AS BIGINT) AS end_offset, CAST(line AS BIGINT) AS line, trim(piece) AS content, span_kind
  FROM piece WHERE trim(piece) <> ''
)"""

CLAIMS_SQL = SPANS_SQL + """, claim AS (
  SELECT 'ec-' || f.doc_id || '-' || f.start_offset AS evidence_claim_id, f.doc_id, f.line, statement, array_to_string(w[1:2], ' ') AS subject, coalesce(w[3], 'is') AS predicate,
         CASE WHEN len(list_filter(w, lambda x: lower(x) IN ('not', 'no', 'nicht', 'kein', 'pas', 'non'))) > 0 THEN 'negative' ELSE 'positive' END AS polarity,
         d.lang AS scope, d.source, CASE WHEN f.line % 5 = 0 THEN 'reported' WHEN f.line % 7 = 0 THEN 'recommended' ELSE 'asserted' END AS modality,
         CASE WHEN f.line % 7 = 0 AND f.doc_id % 2 = 0 THEN 'recommendation' ELSE 'fact' END AS claim_type, CASE WHEN f.doc_id % 3 = 0 THEN d.source END AS attribution
  FROM (SELECT doc_id, line, start_offset, content AS statement, list_filter(string_split(content, ' '), lambda x: x <> '') AS w FROM span) f JOIN documents d ON d.doc_id = f.doc_id
)"""

CANONICAL_SQL = CLAIMS_SQL + """, canonical AS (
  SELECT 'cc_' || substr(sha256(statement), 1, 12) AS canonical_claim_id, statement,
         coalesce(list(evidence_claim_id ORDER BY evidence_claim_id) FILTER (WHERE doc_id % 2 = 0), []) AS supporting,
         coalesce(list(evidence_claim_id ORDER BY evidence_claim_id) FILTER (WHERE doc_id % 2 = 1), []) AS opposing,
         regexp_matches(statement, '^[A-D]') AS derived, regexp_matches(statement, '^[XYZ]') AS superseded
  FROM claim GROUP BY statement
)"""
