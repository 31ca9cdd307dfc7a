"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import line_templates, middle, mixing, packing, passages, quality, rules, search, secrets, simhash, suffixes, warc, whitening
from factloom.llm.common import new_folder
from factloom.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "archive")
    warc.write_warc(table(spark, sf_dir, "pages"), root)
    return warc.read_warc(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def tokenizer_path() -> str:
    """The public vocabulary's file on this machine; it belongs to an installed package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 50 = 0"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_ids(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "copy", "block", F.round("place", 9).alias("place"), F.round("weight", 9).alias("weight"), F.round("passes", 6).alias("passes"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = middle.restore(F.col("output"), F.col("form"))
    return found.select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_substrings(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.last_id IS NOT NULL AND g.last_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last_id <> p.page_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), parsed AS (
  SELECT doc_id, pos, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS m FROM line
), judged AS (
  SELECT *, list_prepend(CAST(len(m) AS VARCHAR), m[1:3]) AS leaf FROM parsed WHERE len(m) > 0
), forms AS (
  SELECT leaf, m, count(DISTINCT doc_id) AS docs FROM judged GROUP BY leaf, m
), spelled AS (
  SELECT leaf, m, docs, i, m[i] AS token FROM (SELECT leaf, m, docs, unnest(generate_series(1, len(m))) AS i FROM forms)
), solid AS (
  SELECT leaf, i, token FROM spelled WHERE token <> '<*>' GROUP BY leaf, i, token HAVING sum(docs) >= 10
), shaped AS (
  SELECT s.leaf, s.m, s.docs, list(CAST(s.i AS VARCHAR) || ' ' || s.token ORDER BY s.i) FILTER (WHERE d.token IS NOT NULL) AS c
  FROM spelled s LEFT JOIN solid d ON s.leaf = d.leaf AND s.i = d.i AND s.token = d.token GROUP BY s.leaf, s.m, s.docs
), likely AS (
  SELECT leaf, m, c FROM shaped WHERE len(c) >= len(m) * 0.6 OR docs >= 10 AND len(c) > 0
), often AS (
  SELECT l.leaf, l.c, min(j.doc_id) AS first_doc FROM likely l JOIN judged j ON j.leaf = l.leaf AND j.m = l.m
  GROUP BY l.leaf, l.c HAVING count(DISTINCT j.doc_id) >= 10
), gone AS (
  SELECT j.doc_id, j.pos FROM judged j JOIN likely l ON j.leaf = l.leaf AND j.m = l.m
  JOIN often o ON o.leaf = l.leaf AND o.c = l.c WHERE j.doc_id <> o.first_doc
)
SELECT p.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
       md5(coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
FROM line p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
"""

MIXING_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5('block|' || doc_id), 1, 8)) AS BIGINT) % 256 AS block,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents
), by_source AS (SELECT source, sum(words) AS words FROM doc GROUP BY source
), share AS (SELECT source, words, words / sum(words) OVER () AS p FROM by_source
), all_p AS (SELECT list(p ORDER BY source) AS p FROM share
), bisect AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM all_p
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN low ELSE (low + high) / 2 END, CASE WHEN fits THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT i, low, high,
      pow(list_min(p) / list_max(p), (low + high) / 2 - 1) <= 1.5
      AND ln(list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))))
          - (low + high) / 2 * list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2)))
          <= 0.98 * ln(len(p)) AS fits
    FROM bisect, all_p WHERE i < 40
  )
), mix AS (
  SELECT s.source, s.words AS of_words, pow(s.p, b.high) / (SELECT sum(pow(t.p, b.high)) FROM share t) AS weight,
         round(pow(s.p / (SELECT max(p) FROM share), b.high - 1), 6) AS passes
  FROM share s, (SELECT high FROM bisect WHERE i = 40) b
), by_block AS (SELECT source, block, sum(words) AS words FROM doc GROUP BY source, block
), passed AS (
  SELECT b.source, b.block, b.words, m.of_words, m.weight, m.passes, unnest(generate_series(1, CAST(ceil(m.passes) AS INT))) AS copy
  FROM by_block b JOIN mix m ON b.source = m.source
), ordered AS (
  SELECT *, CAST(('0x' || substr(md5('mix|' || source || '|' || copy || '|' || block), 1, 8)) AS BIGINT) AS h FROM passed
), taken AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source, copy ORDER BY h, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered
), kept AS (
  SELECT * FROM taken WHERE copy <= floor(passes) OR before < (passes - floor(passes)) * of_words
), placed AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY copy, h, block) - 0.5) / count(*) OVER (PARTITION BY source) AS place FROM kept
)
SELECT d.doc_id, d.source, CAST(p.copy AS INT) AS copy, CAST(d.block AS INT) AS block, round(CAST(p.place AS DOUBLE), 9) AS place, round(p.weight, 9) AS weight, round(p.passes, 6) AS passes
FROM doc d JOIN placed p ON d.source = p.source AND d.block = p.block
"""

MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), c AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high FROM c
), o AS (
  SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(low AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(high - low AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM o
"""


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_packing": op5_packing,
        "op6_secret_scans": op6_secret_scans,
        "op7_exact_search": op7_exact_search,
        "op8_source_mixing": op8_source_mixing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_SQL, "op4_line_dedup": LINES_SQL, "op8_source_mixing": MIXING_SQL, "op12_fill_in_middle": MIDDLE_SQL}
