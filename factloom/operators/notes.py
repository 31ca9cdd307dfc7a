"""Checks of collected articles and video notes, as violation tables over note rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import timecode, urls
from factloom.operators import ordering
from factloom.operators.rules import union, violated, violations
from factloom.session import stored

ASSETS = "Knowledge Assets/"
_VIDEO_LINK = r"https://(?:youtu\.be/[A-Za-z0-9_-]{11}[^)\s>]*|(?:www\.)?youtube\.com/watch\?[^)\s>]*v=[A-Za-z0-9_-]{11}[^)\s>]*)"
_LINK_ID = r"(?:youtu\.be/|[?&]v=)([A-Za-z0-9_-]{11})"
_LINK_TIME = r"[?&]t=(\d+)s?(?:[&#]|$)"


def parsed(notes: DataFrame) -> DataFrame:
    """notes (path, markdown) with n: the strict five-field front matter and body."""
    return notes.withColumn("n", T.strict_front_matter(F.col("markdown")))


def _common(p: DataFrame, placeholder: str) -> list[DataFrame]:
    key, n = F.col("path"), F.col("n")
    fine = n["problem"].isNull()
    remote = n["body"].rlike(T.REMOTE_IMAGE) | n["body"].rlike(r"(?i)<img\b[^>]*\bsrc=[\"']\s*https?://")
    return [violated(
        p,
        ("NOTE_FRONT_MATTER", key, ~fine, n["problem"]),
        ("NOTE_TITLE", key, fine & (n["title"] == "")),
        ("NOTE_PUBLISHED", key, fine & (n["published"] != "") & ~n["published"].rlike(r"^\d{4}-\d{2}-\d{2}$"), n["published"]),
        ("NOTE_CAPTURED", key, fine & ~n["captured"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), n["captured"]),
        ("NOTE_EMPTY", key, fine & (F.trim(F.regexp_replace(n["body"], r"\s+", " ")) == "")),
        ("NOTE_PLACEHOLDER", key, fine & n["body"].rlike(placeholder)),
        ("NOTE_REMOTE_IMAGE", key, fine & remote),
    )]


def article_rules(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """Collected articles; assets: (path, mime) of the localised images that exist."""
    p = stored(parsed(notes))  # read by every rule
    fine = p.where("n.problem IS NULL")
    images = fine.select("path", F.explode(F.array_distinct(T.image_destinations(F.col("n.body")))).alias("image"))
    met = images.join(assets.select(F.col("path").alias("image"), "mime"), "image", "left")
    return union(
        *_common(p, r"\{\{KNOWLEDGE_IMAGE_\d+\}\}"),
        violations(fine, "NOTE_SOURCE_URL", F.col("path"), ~F.coalesce(F.lower(F.col("n.source_url")).rlike("^https?://[^/]+"), F.lit(False)), F.col("n.source_url")),
        violations(met, "NOTE_IMAGE_PLACE", F.col("path"), ~F.col("image").startswith(ASSETS) | ~urls.is_safe_relative(F.col("image")), F.col("image")),
        violations(met, "NOTE_IMAGE_MISSING", F.col("path"), F.col("mime").isNull(), F.col("image")),
    )


def timeline(notes: DataFrame) -> DataFrame:
    """(path, position, seconds, is_slide, target) of the video links with a time and the slides, in
    text order."""
    return _timeline(parsed(notes))


def _timeline(p: DataFrame) -> DataFrame:
    p = p.where("n.problem IS NULL")
    body = F.col("n.body")
    token = rf"(?s)({_VIDEO_LINK})|(!\[[^\]]*\]\([^)]*\))"
    found = p.select("path", F.posexplode(F.regexp_extract_all(body, F.lit(token), F.lit(0))).alias("position", "t"))
    slide = F.col("t").startswith("![")
    target = F.when(slide, T.image_destinations(F.col("t"))[0]).otherwise(F.col("t"))
    seconds = F.when(slide, timecode.slide_seconds(target)).otherwise(F.regexp_extract("t", _LINK_TIME, 1).try_cast("int"))
    return found.select("path", "position", seconds.alias("seconds"), slide.alias("is_slide"), target.alias("target"))


def video_rules(notes: DataFrame, files: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Video notes; files: (video_id, path) of published assets, durations: (path, duration)."""
    p = stored(parsed(notes))  # read by every rule
    files = stored(files)
    fine = p.where("n.problem IS NULL").withColumn("video_id", urls.video_id(F.col("n.source_url")))
    key, body = F.col("path"), F.col("n.body")
    folder = F.concat(F.lit("Video Assets/yt-"), F.col("video_id"))
    links = fine.select("path", "video_id", F.explode(F.regexp_extract_all(body, F.lit(_VIDEO_LINK), F.lit(0))).alias("link"))
    timed = F.size(F.filter(F.regexp_extract_all(body, F.lit(_VIDEO_LINK), F.lit(0)), lambda x: x.rlike(_LINK_TIME)))
    transcripts = F.size(F.filter(T.link_destinations(body, True), lambda x: x.startswith(F.concat(folder, F.lit("/transcript."))) & x.endswith(".vtt")))
    images = fine.select("path", "video_id", F.explode(T.image_destinations(body)).alias("image"))
    twice = images.groupBy("path", "image").count().where("count > 1")
    marks = stored(_timeline(p))
    placed = ordering.nearest(marks.where("seconds IS NOT NULL"), "path", "position", "seconds", "is_slide")
    spoken = marks.where("NOT is_slide AND seconds IS NOT NULL")
    if durations is not None:
        spoken = spoken.join(durations, "path", "left")
    breaks = ordering.order_breaks(spoken, "path", "position", "seconds", None if durations is None else "duration")
    slides = ordering.order_breaks(marks.where("is_slide AND seconds IS NOT NULL"), "path", "position", "seconds")
    alts = fine.select("path", F.explode(F.regexp_extract_all(body, F.lit(r"!\[([^\]]*)\]\("), F.lit(1))).alias("alt"))
    own = files.where(F.col("path").rlike(r"/slides/")).select("video_id", F.col("path").alias("image"))
    unused = own.join(images, ["video_id", "image"], "left_anti")
    return union(
        *_common(p, r"\{\{[^}]+\}\}"),
        violations(fine, "NOTE_SOURCE_URL", key, F.col("video_id").isNull() | (F.col("n.source_url") != urls.video_url(F.col("n.source_url"))), F.col("n.source_url")),
        violations(links, "NOTE_OTHER_VIDEO", key, F.regexp_extract("link", _LINK_ID, 1) != F.col("video_id"), F.col("link")),
        violations(fine, "NOTE_NO_TIMESTAMP", key, timed == 0),
        violations(fine, "NOTE_TRANSCRIPT", key, transcripts != 1, transcripts),
        violations(fine, "NOTE_STYLE", key, F.size(T.style_violations(body)) > 0, F.array_join(T.style_violations(body), ",")),
        violations(twice, "NOTE_SLIDE_TWICE", key, F.lit(True), F.col("image")),
        violations(images, "NOTE_SLIDE_PLACE", key, ~F.col("image").startswith(F.concat(folder, F.lit("/slides/"))), F.col("image")),
        violations(alts, "NOTE_SLIDE_ALT", key, (F.trim("alt") == "") | T.is_generic_alt(F.trim("alt")), F.col("alt")),
        violations(breaks, "NOTE_TIME_ORDER", key, F.lit(True), F.col("why")),
        violations(slides, "NOTE_SLIDE_ORDER", key, F.lit(True), F.col("target")),
        violations(ordering.misplaced(placed, "seconds"), "NOTE_SLIDE_POSITION", key, F.lit(True), F.col("target")),
        violations(unused, "NOTE_SLIDE_UNUSED", F.col("image"), F.lit(True)),
        violations(files, "NOTE_WORKING_FILE", F.col("path"), F.col("path").rlike(r"(?i)\.(?:mp4|mkv|webm|mov|m4a|mp3|wav|opus|json)$")),
    )


def candidate_rules(candidates: DataFrame, expected: int, most: int = 1000) -> DataFrame:
    """Slide candidates: file names, image signatures, and a count that is neither capped nor wrong.

    candidates: (name, mime), mime null where the file is missing or no image.
    """
    n = candidates.agg(F.count("*").alias("n"))
    return union(
        violations(candidates, "CANDIDATE_NAME", F.col("name"), ~F.col("name").rlike(r"^\d{3,}-\d{2}h\d{2}m\d{2}s\.jpg$")),
        violations(candidates, "CANDIDATE_IMAGE", F.col("name"), F.col("mime").isNull()),
        violations(n, "CANDIDATE_COUNT", F.lit("all"), (F.col("n") != expected) | (F.col("n") > most), F.col("n")),
    )
