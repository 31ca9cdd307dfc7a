"""Source identity: classification, variant groups, the five identities, translation pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.hashing import stable_id

TIERS = {
    "faithful-translation": "faithful-variant", "course-note": "derived-note", "collected-article": "local-source-snapshot",
    "user-note": "user-authored", "unknown-markdown": "unverified-local",
}


def source_kind(stem: Column, source_url: Column, keys: Column, marker: Column, need_tags: bool = True) -> Column:
    """Kind of a source; the first rule that fits decides.

    keys are the names of its metadata. A collected article has the five-field block; with need_tags
    also tags, which collectors that write five fields never have.
    """
    url = F.coalesce(F.trim(source_url), F.lit(""))
    wanted = ["title", "author", "source_url", "captured", *["tags"] * need_tags]
    has_all = F.size(F.array_except(F.array(*(F.lit(k) for k in wanted)), keys)) == 0
    return (
        F.when(stem.endswith(T.TRANSLATION_SUFFIX), "faithful-translation")
        .when(url.contains("youtube.com/") | url.contains("youtu.be/"), "course-note")
        .when((url != "") & has_all, "collected-article")
        .when(marker == "user-authored", "user-note")
        .otherwise("unknown-markdown")
    )


def tier(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TIERS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def variant_groups(sources: DataFrame) -> DataFrame:
    """sources with variant_key, variant_role, logical_source_id and extraction_path.

    Sources with one URL are variants of one work, others stand alone. Originals come before
    translations, then paths decide; the first is extracted and lends the group its id.
    """
    key = F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")).otherwise(F.concat(F.lit("local:"), F.col("source_id")))
    translated = F.col("source_kind") == "faithful-translation"
    keyed = sources.withColumn("variant_key", key).withColumn("translated", translated)
    lead = F.min(F.struct("translated", "path", "source_id")).alias("lead")
    groups = keyed.groupBy("variant_key").agg(F.count("*").alias("n"), lead)
    first = F.struct("translated", "path", "source_id") == F.col("lead")
    role = F.when(F.col("n") == 1, "sole").when(F.col("translated"), "translation").when(first, "original").otherwise("duplicate")
    met = keyed.join(groups, "variant_key").withColumn("variant_role", role)
    return met.withColumn("logical_source_id", F.col("lead.source_id")).withColumn("extraction_path", F.col("lead.path")).drop("translated", "n", "lead")


def identities(df: DataFrame, exact_case: bool = True) -> DataFrame:
    """df with document_id, work_id, corpus_id, publisher_id and independence_group_id.

    Takes path, source_id, source_url, source_kind, title, author and the overrides publisher, corpus
    and independence_group, which win where they are set. Parts of one course share corpus and
    independence, not work. exact_case folds case in full by an Arrow UDF; otherwise lower() does.
    """
    fold = T.casefold if exact_case else F.lower
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    publisher = fold(F.trim(F.coalesce(filled("publisher"), filled("author"), F.lit("unknown"))))
    work = F.coalesce(filled("source_url"), F.concat(F.lit("local:"), F.col("source_id")))
    course = F.split("title", r"(?i)\s*\|\s*Part\s+\d+", 2)[0]
    named = df.withColumn("publisher_key", publisher).withColumn("course_key", fold(course))
    shared = F.when(F.col("source_kind") == "course-note", F.concat_ws(":", F.lit("course"), "publisher_key", "course_key")).otherwise(work)
    corpus = F.coalesce(filled("corpus"), shared)
    group = F.coalesce(filled("independence_group"), F.when(F.col("source_kind") == "course-note", corpus).otherwise(work))
    return (
        named.withColumn("document_id", stable_id("document", F.col("path"))).withColumn("work_id", stable_id("work", work))
        .withColumn("corpus_id", stable_id("corpus", corpus)).withColumn("publisher_id", stable_id("publisher", F.col("publisher_key")))
        .withColumn("independence_group_id", stable_id("independence", group)).drop("publisher_key", "course_key")
    )


def translation_check(pairs: DataFrame, original: str, translated: str, least: float = 0.25, most: float = 2.0) -> DataFrame:
    """pairs with length_ratio and check: passed, or the first property that a translation changed.

    Front matter, code, image and link targets and the order of block types must be equal, the
    length plausible, and a text that looks Latin must have become Chinese. Lengths are code points.
    """
    front = lambda c: F.regexp_extract(c, r"^(---\n[\s\S]*?\n---\n)", 1)
    body = lambda c: F.regexp_replace(c, r"^---\n[\s\S]*?\n---\n", "")
    # cut and stripped in projections of their own: branches of a CASE would do it again each
    bodies = pairs.withColumn("_a", body(F.col(original))).withColumn("_b", body(F.col(translated)))
    plain = bodies.withColumn("_plain_a", T.plain_text(F.col("_a"))).withColumn("_plain_b", T.plain_text(F.col("_b")))
    a, b, plain_a, plain_b = map(F.col, ("_a", "_b", "_plain_a", "_plain_b"))
    ratio = F.length(plain_b) / F.greatest(F.length(plain_a), F.lit(1))
    latin = T.latin_count(plain_a) >= F.greatest(F.lit(20.0), F.length(plain_a) * 0.2)
    check = (
        F.when(F.trim(F.col(translated)) == "", "empty")
        .when(front(F.col(original)) != front(F.col(translated)), "metadata")
        .when(T.code_blocks(a) != T.code_blocks(b), "code")
        .when(T.image_destinations(a) != T.image_destinations(b), "images")
        .when(T.link_destinations(a) != T.link_destinations(b), "links")
        .when(T.block_types(a) != T.block_types(b), "block-structure")
        .when((ratio < least) | (ratio > most), "length-ratio")
        .when(latin & (T.han_count(plain_b) < 10), "no-chinese")
        .otherwise("passed")
    )
    return plain.withColumn("length_ratio", F.round(ratio, 3)).withColumn("check", check).select(*pairs.columns, "length_ratio", "check")


def translation_pairs(notes: DataFrame, path: str = "path") -> DataFrame:
    """Translations with their original by stem; original_path is null where it is not among the notes."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    keyed = notes.withColumn("pair_key", F.concat(folder, T.pair_stem(stem)))
    originals = notes.select(F.concat(folder, stem).alias("pair_key"), F.col(path).alias("original_path"))
    return keyed.where("pair_key IS NOT NULL").join(originals, "pair_key", "left").drop("pair_key")
