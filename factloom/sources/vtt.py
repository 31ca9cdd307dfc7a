"""WebVTT captions: parsed into cue rows and written from segments, with expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.timecode import caption_clock, caption_seconds

_TIMING = r"^(\S+)\s+-->\s+(\S+)"


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, start, end, text, problem) from one caption file a row.

    A cue is a timing line and the lines after it up to a blank one. Tags and &nbsp; are dropped,
    white space collapses, cues without text vanish. problem is set on a row of its own, without
    cue, for files that do not begin with WEBVTT, have a wrong timing, or have no usable cue; the
    cues of such files are not returned.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), r"\r\n?", "\n")
    files = df.select(F.col(key).alias("key"), clean.alias("vtt"))
    lines = files.where(F.col("vtt").startswith("WEBVTT")).select("key", F.split("vtt", "\n", -1).alias("l"))
    # a line is in a cue from its timing to the next blank line: the cue's number, or zero
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<struct<cue:int,timing:string,line:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        starts = ~a["open"] & x.rlike(_TIMING)
        blank = F.trim(x) == ""
        n = F.when(starts, a["n"] + 1).otherwise(a["n"])
        row = F.when(starts, F.array(F.struct(n.alias("cue"), x.alias("timing"), F.lit("").alias("line"))))
        row = row.when(a["open"] & ~blank, F.array(F.struct(n.alias("cue"), F.lit(None).cast("string").alias("timing"), x.alias("line"))))
        return F.struct(n.alias("n"), (starts | (a["open"] & ~blank)).alias("open"), F.concat(a["out"], F.coalesce(row, F.array().cast("array<struct<cue:int,timing:string,line:string>>"))).alias("out"))

    marked = lines.select("key", F.explode(F.aggregate("l", state, step, lambda a: a["out"])).alias("c")).select("key", "c.cue", "c.timing", F.col("c.line").alias("line"), F.monotonically_increasing_id().alias("at"))
    told = F.sort_array(F.collect_list(F.struct("at", F.regexp_replace("line", "<[^>]*>", "").alias("line"))))
    cues = marked.groupBy("key", "cue").agg(F.max("timing").alias("timing"), F.array_join(F.transform(told, lambda x: x["line"]), " ").alias("text"))
    timed = cues.select(
        "key", "cue",
        caption_seconds(F.regexp_extract("timing", _TIMING, 1)).alias("start"),
        caption_seconds(F.regexp_extract("timing", _TIMING, 2)).alias("end"),
        F.trim(F.regexp_replace(F.replace("text", F.lit("&nbsp;"), F.lit(" ")), r"\s+", " ")).alias("text"),
    )
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start"))
    by_file = timed.groupBy("key").agg(F.max(wrong).alias("wrong"), F.max(F.col("text") != "").alias("some"))
    judged = files.join(by_file, "key", "left").select(
        "key",
        F.when(~F.col("vtt").startswith("WEBVTT"), "not WEBVTT").when(F.col("wrong"), "timing").when(~F.coalesce("some", F.lit(False)), "no cues").alias("problem"),
    )
    fine = timed.where("text != ''").join(judged.where("problem IS NULL").select("key"), "key", "left_semi")
    empty = judged.where("problem IS NOT NULL").select("key", F.lit(None).cast("int").alias("cue"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("text"), "problem")
    return fine.withColumn("problem", F.lit(None).cast("string")).unionByName(empty).withColumnRenamed("key", key)


def render(df: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """(key, vtt): one caption file from the segments of a key; cue numbers count empty segments too."""
    said = F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("-->"), F.lit("→"))
    rows = df.select(key, F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), said.alias("t")).alias("x"))
    cues = F.transform(
        F.sort_array("x"), lambda x, i: F.when(x["t"] != "", F.concat((i + 1).cast("string"), F.lit("\n"), caption_clock(x["s"]), F.lit(" --> "), caption_clock(x["e"]), F.lit("\n"), x["t"], F.lit("\n")))
    )
    return rows.groupBy(key).agg(F.collect_list("x").alias("x")).select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.filter(cues, lambda c: c.isNotNull()), "\n")).alias("vtt"))


def transcript_buckets(cues: DataFrame, key: str = "key", seconds: int = 600) -> DataFrame:
    """(key, bucket, start_seconds, end_seconds, cue_count) of the cues in file order.

    A cue is dropped if its text equals the one before it in the bucket: equal runs collapse, so this
    is the same as comparing with the last kept one. Start is the first kept cue's, end the last's.
    """
    from pyspark.sql import Window

    placed = cues.withColumn("bucket", F.floor(F.col("start") / seconds))
    before = F.lag("text").over(Window.partitionBy(key, "bucket").orderBy("cue"))
    kept = placed.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("text")))
    return kept.groupBy(key, "bucket").agg(F.min_by("start", "cue").alias("start_seconds"), F.max_by("end", "cue").alias("end_seconds"), F.count("*").alias("cue_count"))
