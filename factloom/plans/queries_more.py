"""Queries over records in files, frames, notes, headings, images and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import text
from factloom.operators import frames, identity, incremental, notes
from factloom.plans.registry import registry
from factloom.session import shared_folder, table
from factloom.sources import images, raw_frames, records

QUERIES, SQL, query = registry()

_LINES = (
    "CASE doc_id % 8 WHEN 0 THEN '{\"doc_id\":' || doc_id WHEN 1 THEN '{\"doc_id\":' || doc_id || ',\"quality\":1,\"more\":2}' WHEN 2 THEN '{\"doc_id\":' || doc_id || '}' WHEN 3 THEN '{\"doc_id\":' || doc_id || ',\"quality\":\"' || quality || '\"}' "
    "WHEN 4 THEN '[1]' WHEN 5 THEN ' ' ELSE '{\"doc_id\":' || doc_id || ',\"quality\":' || quality || '}' END"
)


@query("""SELECT detail, count(*) AS n FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'unknown field more' WHEN 2 THEN 'missing field quality' WHEN 3 THEN 'type of quality' WHEN 4 THEN 'not an object' ELSE 'good ' || quality END AS detail FROM labels WHERE doc_id % 8 <> 5) GROUP BY detail""")
def io_jsonl_read(spark, d):
    folder = shared_folder(spark, "lines")
    table(spark, d, "labels").select(F.expr(_LINES).alias("value")).write.text(folder)
    shape = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("quality", T.LongType(), False)])
    good, bad = records.read_jsonl(spark, folder, shape)
    return good.select(F.concat(F.lit("good "), "quality").alias("detail")).unionByName(bad.select("detail")).groupBy("detail").agg(F.count("*").alias("n"))


@query("""SELECT CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR) AS line FROM documents""")
def io_jsonl_write(spark, d):
    folder = shared_folder(spark, "lines")
    records.write_jsonl(table(spark, d, "documents"), folder, "doc_id")
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("""WITH b AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations)
SELECT conv_id, turn, CAST(i AS INTEGER) AS number, sha256(substr(h, i * 60 + 1, 60)) AS digest, CAST(NULL AS VARCHAR) AS refused FROM (SELECT *, unnest(generate_series(0, length(h) // 60 - 1)) AS i FROM b WHERE length(h) >= 60)
UNION ALL SELECT conv_id, turn, NULL, CAST(length(h) // 2 % 30 AS VARCHAR), 'TRUNCATED_FRAME' FROM b WHERE length(h) % 60 <> 0 UNION ALL SELECT conv_id, turn, NULL, NULL, 'NO_FRAMES' FROM b WHERE length(h) = 0""")
def io_frame_scan(spark, d):
    """Texts as streams of frames of thirty bytes."""
    key = F.concat_ws("-", "conv_id", "turn").alias("key")
    found, bad = frames.scan(table(spark, d, "conversations").select(key, F.encode("text", "UTF-8").alias("raw")), "key", "raw", 30)
    both = found.select("key", "number", F.sha2(F.hex("frame"), 256).alias("digest"), F.lit(None).cast("string").alias("refused"))
    both = both.unionByName(bad.select(F.col("record_id").alias("key"), F.lit(None).cast("int").alias("number"), F.col("detail").alias("digest"), F.col("rule_code").alias("refused")))
    part = F.split("key", "-")
    return both.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "number", "digest", "refused")


@query("""SELECT doc_id, sha256(lpad(CAST(doc_id AS VARCHAR), 15, '0') || substr(md5(coalesce(text, '')), 1, 16) || chr(10)) AS digest FROM documents""")
def io_frames_read(spark, d):
    """Records of 32 bytes as frames of files that are cut into ranges."""
    folder = shared_folder(spark, "frames")
    record = F.concat(F.lpad(F.col("doc_id").cast("string"), 15, "0"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16))
    table(spark, d, "documents").select(record.alias("value")).write.option("lineSep", "\n").text(folder)
    found = raw_frames.read_frames(spark, folder, 32, split_bytes=1 << 20)
    return found.select(F.substring(F.decode("frame", "UTF-8"), 1, 15).cast("long").alias("doc_id"), F.sha2("frame", 256).alias("digest"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 255) % 256 AS INTEGER)) AS v FROM embeddings)
SELECT vec_id, array_to_string(list_transform(generate_series(0, 11), lambda i: v[8 * least(7, CAST(floor(1 + (i // 4 + 0.5) * 6 / 3) AS INTEGER)) + least(7, CAST(floor(2 + (i % 4 + 0.5) * 5 / 4) AS INTEGER)) + 1]), ',') AS signature FROM e""")
def s_signature_resample(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x) * 255) % 256).cast("int")).alias("v"))
    rgb = F.unhex(F.array_join(F.flatten(F.transform("v", lambda x: F.array_repeat(F.lpad(F.hex(x), 2, "0"), 3))), ""))
    hexed = v.select("vec_id", F.hex(frames.resampled(8, 8, (2, 1, 5, 6), (4, 3))(rgb)).alias("h"))
    return hexed.select("vec_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.conv(F.substring("h", 2 * i + 1, F.lit(2)), 16, 10)), ",").alias("signature"))


@query("""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '```' || chr(10) || '# Title' || chr(10) || '```' || chr(10) || text WHEN 2 THEN '# Other' || chr(10) || chr(10) || text ELSE 'lead' || chr(10) || 'more' || chr(10) || text END) AS body FROM documents""")
def m_first_heading(spark, d):
    k = F.col("doc_id") % 4
    note = (
        F.when(k == 0, F.concat(F.lit("# **Title**\n\n"), "text")).when(k == 1, F.concat(F.lit("```\n# Title\n```\n# Title\n"), "text"))
        .when(k == 2, F.concat(F.lit("# Other\n\n"), "text")).otherwise(F.concat(F.lit("lead\n# Title #\n\nmore\n"), "text"))
    )
    return table(spark, d, "documents").select("doc_id", F.sha2(text.remove_first_heading(note, F.lit("Title")), 256).alias("body"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a ![\\[' || lang || '\\]](<Knowledge Assets/01-' || substr(sha256(text), 1, 12) || '.png>) b' WHEN doc_id % 3 = 1 THEN 'a  b' ELSE '![x](<Knowledge Assets/02-' || substr(sha256(source), 1, 12) || '.jpg>)![x](<Knowledge Assets/02-' || substr(sha256(source), 1, 12) || '.jpg>)' END AS note FROM documents""".replace("\\\\", "\\"))
def m_image_localise(spark, d):
    k = F.col("doc_id") % 3
    name = F.when(k == 0, images.local_name(F.lit(1), F.col("text"), F.lit("image/png"))).when(k == 2, images.local_name(F.lit(2), F.col("source"), F.lit("image/jpeg")))
    token = F.format_string("{{KNOWLEDGE_IMAGE_%d}}", k)
    note = F.when(k == 2, F.concat(token, token)).otherwise(F.concat(F.lit("a "), token, F.lit(" b")))
    alt = F.when(k == 0, F.concat(F.lit("["), "lang", F.lit("]"))).otherwise("x")
    found = F.array(F.struct(token.alias("token"), alt.alias("alt"), F.concat(F.lit(notes.ASSETS), name).alias("path")))
    return table(spark, d, "documents").select("doc_id", images.localise(note, found).alias("note"))


@query("""WITH n AS (SELECT conv_id AS c, conv_id % 9 AS k, 'n/' || conv_id AS path FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT 'NOTE_FRONT_MATTER' AS rule_code, path AS record_id, CAST(NULL AS VARCHAR) AS detail FROM n WHERE k = 0 UNION ALL SELECT 'NOTE_TITLE', path, NULL FROM n WHERE k = 1 UNION ALL SELECT 'NOTE_PUBLISHED', path, '2024/01/02' FROM n WHERE k = 2
UNION ALL SELECT 'NOTE_CAPTURED', path, 'today' FROM n WHERE k = 3 UNION ALL SELECT 'NOTE_EMPTY', path, NULL FROM n WHERE k = 4 UNION ALL SELECT 'NOTE_PLACEHOLDER', path, NULL FROM n WHERE k = 5 UNION ALL SELECT 'NOTE_REMOTE_IMAGE', path, NULL FROM n WHERE k = 6
UNION ALL SELECT 'NOTE_IMAGE_PLACE', path, 'https://h.example/' || c || '.png' FROM n WHERE k = 6 UNION ALL SELECT 'NOTE_IMAGE_MISSING', path, 'https://h.example/' || c || '.png' FROM n WHERE k = 6
UNION ALL SELECT 'NOTE_SOURCE_URL', path, 'ftp://h/' || c FROM n WHERE k = 7 UNION ALL SELECT 'NOTE_IMAGE_MISSING', path, 'Knowledge Assets/' || c || '.png' FROM n WHERE k = 8""")
def p_article_note(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("k", F.col("conv_id") % 9)
    k, n = F.col("k"), F.col("conv_id")
    image = F.when(k == 6, F.concat(F.lit("![i](https://h.example/"), n, F.lit(".png)"))).otherwise(F.concat(F.lit("![i](<Knowledge Assets/"), n, F.lit(".png>)")))
    body = F.when(k == 4, "").otherwise(F.concat(F.lit("Text "), n, F.when(k == 5, " {{KNOWLEDGE_IMAGE_1}}").otherwise(""), F.lit("\n\n"), image))
    lines = F.concat_ws(
        "\n", F.lit("---"), F.when(k == 1, "title:").otherwise(F.concat(F.lit("title: T"), n)), F.lit("author: a"), F.concat(F.lit("source_url: "), F.when(k == 7, "ftp://h/").otherwise("https://h.example/"), n),
        F.when(k == 2, "published: 2024/01/02").otherwise("published: 2024-01-02"), F.when(k == 3, "captured: today").otherwise("captured: 2024-01-01T00:00:00"), F.when(k == 0, "+++").otherwise("---"), body, F.lit(""),
    )
    files = c.where("k != 8").select(F.concat(F.lit(notes.ASSETS), n, F.lit(".png")).alias("path"), F.lit("image/png").alias("mime"))
    found = notes.article_rules(c.select(F.concat(F.lit("n/"), n).alias("path"), lines.alias("markdown")), files)
    return found.select("rule_code", "record_id", F.when(F.col("rule_code") != "NOTE_FRONT_MATTER", F.col("detail")).alias("detail"))


@query(f"""WITH n AS (SELECT doc_id, 'd' || doc_id % 5 || '/' || doc_id // 2 || CASE WHEN doc_id % 2 = 1 THEN '{text.TRANSLATION_SUFFIX}' ELSE '' END || '.md' AS path FROM documents WHERE doc_id % 11 > 0)
SELECT t.path, o.path AS original_path FROM n t LEFT JOIN n o ON o.path = replace(t.path, '{text.TRANSLATION_SUFFIX}', '') WHERE t.doc_id % 2 = 1""")
def x_pair_keys(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("d"), k % 5, F.lit("/"), F.expr("doc_id div 2"), F.when(k % 2 == 1, text.TRANSLATION_SUFFIX).otherwise(""), F.lit(".md"))
    found = table(spark, d, "documents").where("doc_id % 11 > 0").select(path.alias("path"))
    return identity.translation_pairs(found).select("path", "original_path")


@query("""SELECT 'INVALID_IR' AS rule_code, 'concept_part' || p_partkey AS record_id, 'size(related_concept_ids) = size(relation_types)' AS detail FROM part WHERE p_size % 3 <> p_size % 4
UNION ALL SELECT 'INVALID_IR', 'concept_part' || p_partkey, 'relation_types: in:is-a|part-of|depends-on|enables|contrasts-with|related-to|supersedes' FROM part WHERE p_partkey % 7 = 0 AND p_size % 4 > 0
UNION ALL SELECT 'INVALID_IR', 'concept_part' || p_partkey, 'related_concept_ids: unique' FROM part WHERE p_partkey % 5 = 0 AND p_size % 3 > 1""")
def u_zip_rule(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    of = lambda m, value: F.when(n % m > 0, F.transform(F.sequence(F.lit(1), (n % m).cast("int")), value)).otherwise(none)
    rows = table(spark, d, "part").select(
        F.concat(F.lit("concept_part"), k).alias("concept_id"), F.col("p_name").alias("preferred_label"), none.alias("aliases"), none.alias("definition_claim_ids"), none.alias("claim_ids"),
        of(3, lambda i: F.when(k % 5 == 0, "concept_same").otherwise(F.concat(F.lit("concept_"), i))).alias("related_concept_ids"), of(4, lambda i: F.when(k % 7 == 0, "like").otherwise("is-a")).alias("relation_types"), F.lit("active").alias("status"),
    )
    return schemas.violations("concepts", rows)


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l_suppkey % 3 = 0")
def i_work_set(spark, d):
    """Line items as units of suppliers, every third of which has changed."""
    units = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("src_"), "l_suppkey").alias("source_id"))
    changed = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("src_"), "s_suppkey").alias("source_id"))
    return incremental.work_set(units, changed).select("l_orderkey", "l_linenumber")
