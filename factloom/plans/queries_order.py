"""Queries over ordered data: frames, segments, transcripts, timestamps, collapse, publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import timecode
from factloom.operators import frames, notes, ordering
from factloom.plans.registry import registry
from factloom.session import table
from factloom.sources import vtt

QUERIES, SQL, query = registry()


def _frames(spark, d):
    """Each user's events as a video of one-pixel frames: at is its number, luma its value."""
    e = table(spark, d, "events")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", (at / 2.0).alias("at"), F.array(F.floor(F.col("value")).cast("int")).alias("signature"), F.round(F.col("value") % 17, 3).alias("score"))


_FRAMES = """WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 2.0::DOUBLE AS "at", CAST(floor(value) AS INTEGER) AS luma, round(value % 17, 3) AS score FROM events),
g AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY user_id ORDER BY "at")) AS gap FROM f),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR NOT (gap <= 0.8 OR (gap <= 2.4 AND CASE WHEN gap > 14 THEN 1 ELSE 0 END <= 0.04)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "at") AS run FROM g)"""


@query(_FRAMES + """, s AS (SELECT user_id, run, count(*) AS sample_count, min("at") AS start_seconds, max("at") AS end_seconds FROM r GROUP BY user_id, run HAVING count(*) >= 2)
SELECT user_id, printf('segment-%04d', row_number() OVER (PARTITION BY user_id ORDER BY run)) AS segment, sample_count, start_seconds, end_seconds FROM s""")
def s_stable_segments(spark, d):
    runs = frames.frame_runs(_frames(spark, d), "user_id", "at", "signature")
    best = frames.representatives(runs, "user_id", "at", "score").where("place = 1")
    return best.select("user_id", frames.segment_name(F.col("segment")).alias("segment"), "sample_count", "start_seconds", "end_seconds")


@query(_FRAMES + """, m AS (SELECT *, count(*) OVER w AS n, row_number() OVER o AS i, lead(gap) OVER o AS nxt FROM r WINDOW w AS (PARTITION BY user_id, run), o AS (PARTITION BY user_id, run ORDER BY "at")),
k AS (SELECT *, round(score - 2 * least(CASE WHEN i > 1 THEN gap END, nxt) - CASE WHEN n > 2 AND (i = 1 OR i = n) THEN 0.5 ELSE 0 END, 3) AS rank_score, dense_rank() OVER (PARTITION BY user_id ORDER BY run) AS segment FROM m WHERE n >= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY rank_score DESC, "at") AS place FROM k)
SELECT user_id, CAST(segment AS INTEGER) AS segment, CAST(place AS INTEGER) AS place, "at", rank_score FROM p WHERE place <= 3""")
def s_representatives(spark, d):
    runs = frames.frame_runs(_frames(spark, d), "user_id", "at", "signature")
    return frames.representatives(runs, "user_id", "at", "score").select("user_id", "segment", "place", "at", "rank_score")


@query("""WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue, event_type AS text FROM events),
b AS (SELECT *, cue * 45.0::DOUBLE AS start, CAST(floor(cue * 45.0 / 600) AS BIGINT) AS bucket FROM c), k AS (SELECT *, lag(text) OVER (PARTITION BY user_id, bucket ORDER BY cue) AS prev FROM b)
SELECT user_id, bucket, arg_min(start, cue) AS start_seconds, arg_max(start, cue) + 5 AS end_seconds, count(*) AS cue_count FROM k WHERE prev IS NULL OR prev <> text GROUP BY user_id, bucket""")
def s_transcript_buckets(spark, d):
    cue = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = table(spark, d, "events").select("user_id", cue.alias("cue"), F.col("event_type").alias("text"))
    return vtt.transcript_buckets(c.withColumn("start", F.col("cue") * 45.0).withColumn("end", F.col("cue") * 45.0 + 5), "user_id")


@query("""WITH l AS (SELECT user_id, event_id, ts, floor(value)::BIGINT AS seconds FROM events), w AS (SELECT *, lag(seconds) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM l)
SELECT user_id, event_id, CASE WHEN prev > seconds THEN 'backwards' ELSE 'beyond duration' END AS why FROM w WHERE prev > seconds OR seconds > 65""")
def s_monotone_check(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("position"), F.floor("value").alias("seconds"), F.lit(60.0).alias("duration"))
    return ordering.order_breaks(e, "user_id", "position", "seconds", "duration").select("user_id", "event_id", "why")


@query("""WITH m AS (SELECT user_id, event_id, ts, floor(value)::BIGINT AS seconds, event_id % 4 = 0 AS q FROM events),
w AS (SELECT *, last_value(CASE WHEN NOT q THEN seconds END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding,
 first_value(CASE WHEN NOT q THEN seconds END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM m)
SELECT event_id, preceding, following, (preceding IS NULL OR preceding > seconds + 5 OR (following IS NOT NULL AND following < seconds - 5)) AS misplaced FROM w WHERE q""")
def s_nearest_timestamp(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("position"), F.floor("value").alias("seconds"), (F.col("event_id") % 4 == 0).alias("q"))
    found = ordering.nearest(e, "user_id", "position", "seconds", "q")
    bad = ordering.misplaced(found, "seconds").select("event_id", F.lit(True).alias("bad"))
    return found.join(bad, "event_id", "left").select("event_id", "preceding", "following", F.coalesce("bad", F.lit(False)).alias("misplaced"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'manual_caption' ELSE 'auto_caption' END AS source, CASE turn % 5 WHEN 0 THEN 'live_chat' WHEN 1 THEN 'fr' WHEN 2 THEN 'de-AT' WHEN 3 THEN 'EN' ELSE 'es' END AS language FROM conversations),
w AS (SELECT unnest(['de', 'en', 'zh']) AS want, unnest([0, 1, 2]) AS preference),
m AS (SELECT t.*, min(CASE WHEN lower(language) = want THEN preference * 10 WHEN starts_with(lower(language), want || '-') THEN preference * 10 + 1 ELSE 1000000 END) AS fit FROM t, w WHERE language <> 'live_chat' GROUP BY ALL)
SELECT conv_id, arg_min(language, (source <> 'manual_caption')::INT * 10000000000 + fit * 1000 + turn) AS language, arg_min(source, (source <> 'manual_caption')::INT * 10000000000 + fit * 1000 + turn) AS source FROM m GROUP BY conv_id""")
def j_caption_choice(spark, d):
    t = F.col("turn")
    language = F.when(t % 5 == 0, "live_chat").when(t % 5 == 1, "fr").when(t % 5 == 2, "de-AT").when(t % 5 == 3, "EN").otherwise("es")
    tracks = table(spark, d, "conversations").select("conv_id", language.alias("language"), F.when(t % 2 == 0, "manual_caption").otherwise("auto_caption").alias("source"), t.alias("ordinal"))
    wanted = tracks.select("conv_id").distinct().select("conv_id", F.explode(F.expr("array(struct(0 as preference, 'de' as language), struct(1 as preference, 'en' as language), struct(2 as preference, 'zh' as language))")).alias("w")).select("conv_id", "w.language", "w.preference")
    return ordering.choose_tracks(tracks, wanted, "conv_id")


_LUMA = "list_transform(embedding, lambda x: CAST(floor(abs(x) * 255) % 256 AS INTEGER))"


def _luma(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (F.floor(F.abs(x) * 255) % 256).cast("int")).alias("v"))


@query(f"""WITH e AS (SELECT vec_id, label, {_LUMA} AS v FROM embeddings), p AS (SELECT a.vec_id, list_transform(generate_series(1, len(a.v)), lambda i: abs(a.v[i] - b.v[i])) AS g FROM e a JOIN e b ON b.vec_id = a.vec_id - 1)
SELECT vec_id, round(list_sum(g) / len(g), 6) AS mean_difference, round(len(list_filter(g, lambda x: x > 14)) / len(g), 6) AS changed_ratio FROM p""")
def a_frame_diff(spark, d):
    v = _luma(spark, d)
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w"))
    diff = frames.difference(F.col("w"), F.col("v"))
    return v.join(before, "vec_id").select("vec_id", F.round(diff["mean_difference"], 6).alias("mean_difference"), F.round(diff["changed_ratio"], 6).alias("changed_ratio"))


@query(f"""WITH e AS (SELECT vec_id, {_LUMA} AS v FROM embeddings), b AS (SELECT vec_id, list_transform(generate_series(0, 63), lambda i: v[(i // 8) * 8 + least(7, CAST(floor((i % 8 + 0.5) * 8 / 9) AS INTEGER)) + 1] > v[(i // 8) * 8 + least(7, CAST(floor((i % 8 + 1.5) * 8 / 9) AS INTEGER)) + 1]) AS b FROM e)
SELECT vec_id, array_to_string(list_transform(generate_series(0, 15), lambda k: substr('0123456789abcdef', 1 + b[4*k+1]::INT * 8 + b[4*k+2]::INT * 4 + b[4*k+3]::INT * 2 + b[4*k+4]::INT, 1)), '') AS dhash FROM b""")
def a_dhash(spark, d):
    return _luma(spark, d).select("vec_id", frames.difference_hash(F.col("v"), 8, 8).alias("dhash"))


@query("SELECT doc_id, CAST(bit_count(xor(('0x' || substr(sha256(text), 1, 8))::BIGINT, ('0x' || substr(sha256(source), 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(sha256(text), 9, 8))::BIGINT, ('0x' || substr(sha256(source), 9, 8))::BIGINT)) AS INTEGER) AS bits FROM documents")
def a_hamming(spark, d):
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return table(spark, d, "documents").select("doc_id", frames.hamming(h("text"), h("source")).alias("bits"))


@query(r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN least(len(a.t), len(b.t)) < 4 THEN 0 ELSE len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) END, 6) AS overlap FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def a_token_overlap(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(frames.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag || l_linenumber END AS t FROM lineitem), s AS (SELECT * FROM w WHERE confidence >= 30 AND trim(t) <> '')
SELECT l_orderkey, string_agg(t, ' ' ORDER BY l_linenumber, t) AS confident_text, count(DISTINCT l_linenumber % 2) AS line_count, count(*) AS word_count FROM s GROUP BY l_orderkey""")
def a_ocr_text(spark, d):
    n = F.col("l_linenumber")
    text = F.when(n % 3 == 0, " ").otherwise(F.concat("l_returnflag", n))
    words = table(spark, d, "lineitem").select("l_orderkey", n.alias("place"), F.lit(1).alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), (n % 2).alias("line"), F.col("l_quantity").alias("confidence"), text.alias("text"))
    return frames.ocr_text(words, "l_orderkey")


@query("SELECT o_orderkey, abs(o_totalprice - CAST(round(o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0)) AS DOUBLE)) <= greatest(5, CAST(round(o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0)) AS DOUBLE) * 0.03) AS fits FROM orders")
def p_duration(spark, d):
    stated = F.round(F.expr("o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0D)"))
    return table(spark, d, "orders").select("o_orderkey", frames.duration_fits(F.col("o_totalprice"), stated).alias("fits"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(floor(value) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%03d-%02dh%02dm%02ds.jpg', n, s // 3600, s % 3600 // 60, s % 60) AS file, printf('sheet-%03d.jpg', (n - 1) // 16 + 1) AS sheet FROM n""")
def s_sheet_names(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("o"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("o"))
    named = frames.sheet_names(e.withColumn("at", n.cast("double")), "user_id")
    file = F.concat(F.format_string("%03d-", "number"), timecode.file_clock(F.col("value")), F.lit(".jpg"))
    return named.select("event_id", file.alias("file"), "sheet")


@query("""WITH b AS (SELECT conv_id, turn, text FROM conversations), l AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'x' ELSE role END ORDER BY turn) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, a = b AS "equal" FROM l""")
def j_sequence_equal(spark, d):
    c = table(spark, d, "conversations")
    other = c.withColumn("role", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), "x").otherwise(F.col("role")))
    return ordering.equal_sequences(c, other, "conv_id", "role", "turn")


@query()
def s_greedy_collapse(spark, d):
    v = _luma(spark, d)
    signature = F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    c = v.select(
        "label", F.concat(F.lit("c"), "vec_id").alias("name"), (F.col("vec_id") * 0.5).alias("at"), F.unhex(signature).alias("signature"), frames.difference_hash(F.col("v"), 8, 8).alias("dhash"),
        F.transform(F.slice("v", 1, 6), lambda x: (x % 4).cast("string")).alias("tokens"), (F.col("v")[0] % 7).cast("double").alias("score"), (F.col("v")[1] % 3 * 0.05).alias("deficit"), (F.col("v")[2] % 2 == 0).alias("cropped"),
    )
    return frames.collapse(c, "label").withColumn("alternates", F.array_join("alternates", ","))


@query(f"""WITH e AS (SELECT vec_id, {_LUMA} AS v FROM embeddings), p AS (SELECT *, list_transform(generate_series(1, 64), lambda i: CASE WHEN i % 8 > 0 THEN abs(v[i + 1] - v[i]) ELSE 0 END + CASE WHEN i <= 56 THEN abs(v[i + 8] - v[i]) ELSE 0 END) AS steps,
  list_filter(v, lambda x, i: i <= 8 OR i > 56 OR i % 8 < 2) AS edge, list_filter(v, lambda x, i: NOT (i <= 8 OR i > 56 OR i % 8 < 2)) AS inside FROM e),
m AS (SELECT *, list_sum(v) / 64.0 AS mean, list_sum(steps) / 112.0 AS sharp, greatest(0, (list_sum(inside) / 36.0 - list_sum(edge) / 28.0) / 255) AS deficit FROM p),
q AS (SELECT *, sqrt(greatest(0, list_sum(list_transform(v, lambda x: x * x)) / 64.0 - mean * mean)) AS contrast FROM m)
SELECT vec_id, round_even(deficit, 4) AS border_luma_deficit, round_even(contrast, 3) AS contrast, round_even(len(list_filter(edge, lambda x: x < 32)) / 28.0, 4) AS dark_border_ratio, round_even(mean, 3) AS mean_luma,
 round_even(1.6 * sharp + 0.1 * contrast - 60 * deficit - 0.5 * len(list_filter(v, lambda x: x <= 5 OR x >= 250)) / 64.0, 3) AS score, round_even(sharp, 3) AS sharpness FROM q""")
def a_frame_quality(spark, d):
    v = _luma(spark, d)
    rgb = F.unhex(F.array_join(F.flatten(F.transform("v", lambda x: F.array_repeat(F.lpad(F.hex(x), 2, "0"), 3))), ""))
    got = v.select("vec_id", frames.describe(8, 8, 1)(rgb).alias("f"))
    return got.select("vec_id", "f.quality.*")


@query("""WITH v AS (SELECT conv_id, substr(md5(CAST(conv_id AS VARCHAR)), 1, 11) AS v, conv_id % 5 AS k FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT 'NOTE_TIME_ORDER' AS rule_code, CAST(conv_id AS VARCHAR) AS record_id, 'backwards' AS detail FROM v WHERE k = 0
UNION ALL SELECT 'NOTE_OTHER_VIDEO', CAST(conv_id AS VARCHAR), 'https://youtu.be/aaaaaaaaaaa' FROM v WHERE k = 1 UNION ALL SELECT 'NOTE_STYLE', CAST(conv_id AS VARCHAR), '6' FROM v WHERE k = 2
UNION ALL SELECT 'NOTE_SLIDE_ALT', CAST(conv_id AS VARCHAR), 'Screenshot 00:10' FROM v WHERE k = 3 UNION ALL SELECT 'NOTE_SLIDE_POSITION', CAST(conv_id AS VARCHAR), 'Video Assets/yt-' || v || '/slides/001-00h00m50s.jpg' FROM v WHERE k = 4""")
def p_video_note(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("v", F.substring(F.md5(F.col("conv_id").cast("string")), 1, 11)).withColumn("k", F.col("conv_id") % 5)
    k, v = F.col("k"), F.col("v")
    link = lambda s: F.concat(F.lit("see https://youtu.be/"), v, F.lit("?t="), s, F.lit("s now"))
    slide = F.concat(F.lit("!["), F.when(k == 3, "Screenshot 00:10").otherwise("Gradient flow"), F.lit("](<Video Assets/yt-"), v, F.when(k == 4, "/slides/001-00h00m50s.jpg>)").otherwise("/slides/001-00h00m10s.jpg>)"))
    lines = F.concat_ws(
        "\n", F.lit("---"), F.lit("title: T"), F.lit("author: a"), F.concat(F.lit("source_url: https://www.youtube.com/watch?v="), v), F.lit("published:"), F.lit("captured: 2024-01-01T00:00:00"), F.lit("---"),
        F.lit("Text"), F.concat(F.lit("[t](<Video Assets/yt-"), v, F.lit("/transcript.en.vtt>)")), link(F.lit("10")), slide, link(F.when(k == 0, "9").otherwise("20")),
        F.when(k == 2, "The speaker then notes it").otherwise("More"), F.when(k == 1, "https://youtu.be/aaaaaaaaaaa").otherwise("end"),
    )
    n = c.select(F.col("conv_id").cast("string").alias("path"), lines.alias("markdown"))
    files = c.select(F.col("v").alias("video_id"), F.concat(F.lit("Video Assets/yt-"), v, F.when(k == 4, "/slides/001-00h00m50s.jpg").otherwise("/slides/001-00h00m10s.jpg")).alias("path"))
    return notes.video_rules(n, files)
