"""Incremental maintenance: what changed since the published build, and what carries over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import fingerprint, stable_id


def carried_ids(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current (path, source_url, content_sha256) with source_id.

    An id carries over from the source of the same path, or else from the only previous source of
    the same content; and only if the URL is the same or there is none. All others get a new id
    from their URL or path.
    """
    by_path = previous.select("path", F.col("source_id").alias("p_id"), F.col("source_url").alias("p_url"))
    by_hash = previous.groupBy("content_sha256").agg(F.count("*").alias("n"), F.first("source_id").alias("h_id"), F.first("source_url").alias("h_url")).where("n = 1").drop("n")
    met = current.join(by_path, "path", "left").join(by_hash, "content_sha256", "left")
    url = F.coalesce("source_url", F.lit(""))
    prior = F.when(F.col("p_id").isNotNull(), F.struct(F.col("p_id").alias("id"), F.col("p_url").alias("url"))).otherwise(F.struct(F.col("h_id").alias("id"), F.col("h_url").alias("url")))
    same = prior["id"].isNotNull() & ((url == "") | prior["url"].eqNullSafe(F.col("source_url")))
    fresh = stable_id("src", F.when(url != "", url).otherwise(F.col("path")))
    return met.withColumn("source_id", F.when(same, prior["id"]).otherwise(fresh)).drop("p_id", "p_url", "h_id", "h_url")


def changed_sources(current: DataFrame, previous: DataFrame, same_schema: bool = True) -> DataFrame:
    """Ids of current sources that differ: in a path's content, or in their whole set of variants."""
    if not same_schema:
        return current.select("source_id").distinct()
    a = current.select("source_id", "path", F.col("content_sha256").alias("now"))
    b = previous.select("source_id", "path", F.col("content_sha256").alias("was"))
    both = a.join(b, ["source_id", "path"], "full_outer")
    # a path that one side lacks changes the set of variants as well, so one join tells both
    differ = both.where(~F.col("now").eqNullSafe(F.col("was"))).select("source_id").distinct()
    return differ.join(current.select("source_id").distinct(), "source_id", "left_semi")


def deleted_sources(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select("source_id").distinct().join(current.select("source_id"), "source_id", "left_anti")


def work_set(units: DataFrame, changed: DataFrame) -> DataFrame:
    return units.join(changed.select("source_id"), "source_id", "left_semi")


def carry_forward(claims: DataFrame, spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Previous claims (with source_id and evidence_span_id) of unchanged sources whose span still exists."""
    kept = claims.join(changed.select("source_id"), "source_id", "left_anti")
    return kept.join(spans.select("evidence_span_id"), "evidence_span_id", "left_semi")


def merge(carried: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(union, ids that both sides or one side twice have)."""
    from factloom.operators.rules import duplicates

    both = carried.unionByName(new)
    return both, duplicates(both, key)


def build_fingerprint(sources: DataFrame, **settings) -> str:
    """Digest of the settings and of all sources; equal means that there is nothing to build."""
    import hashlib
    import json

    rows = fingerprint(sources.select("source_id", "path", "content_sha256"), "source_id", "path").first()[0]
    text = json.dumps({**settings, "sources": rows}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def drift(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose digest differs from the record: changed, missing or unknown. Both: (path, sha256)."""
    both = recorded.select("path", F.col("sha256").alias("r")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("r").isNull(), "unknown").when(F.col("a") != F.col("r"), "changed")
    return both.withColumn("drift", kind).where("drift IS NOT NULL").select("path", "drift")


def unfinished(segments: DataFrame, done: DataFrame, source_sha256: str, version: int) -> DataFrame:
    """Segments that a resumable job has yet to process: results of other sources or versions do not count."""
    fits = done.where((F.col("source_sha256") == source_sha256) & (F.col("version") == version))
    return segments.join(fits.select("segment_id"), "segment_id", "left_anti")


def free_name(wanted: DataFrame, taken: DataFrame, *candidates: str) -> DataFrame:
    """wanted with name: the first of its candidate columns that is not taken, or null."""
    used = taken.select(F.col("name").alias("candidate")).distinct().withColumn("used", F.lit(True))
    rows = wanted.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", F.posexplode(F.array(*candidates)).alias("place", "candidate")).join(used, "candidate", "left").where("used IS NULL")
    first = each.groupBy("row").agg(F.min_by("candidate", "place").alias("name"))
    return rows.join(first, "row", "left").drop("row")


def collected_already(new: DataFrame, notes: DataFrame) -> DataFrame:
    """New pages whose URL some note has; notes that do not parse have none."""
    return new.join(notes.where("source_url IS NOT NULL").select("source_url"), "source_url", "left_semi")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("n = 1").drop("n")
