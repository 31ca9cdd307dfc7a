"""Text and Markdown functions as column expressions; Unicode normal forms need an Arrow UDF."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

TRANSLATION_SUFFIX = "（中文翻译）"
#: Predicates that say nothing, a fixed value.
PLACEHOLDERS = ("is", "are", "说明", "描述", "涉及", "相关", "relation", "related to")
#: Heading texts that a video note may not have, a fixed value.
FORBIDDEN_HEADINGS = (
    "核心概念", "知识地图", "概念地图", "快速回顾", "复习速览",
    "core concepts", "knowledge map", "concept map", "quick review", "review summary",
)
#: Narration of the medium rather than the matter, fixed values.
NARRATION = (
    r"(?i)(?:讲者|老师|主讲人|演讲者|授课者).{0,16}(?:随后|后续|接着|然后|强调|指出|提到|表示|说明|展示|演示)",
    r"(?i)(?:课件|幻灯片|视频|本节课|课堂)(?:中|里|上)?(?:的)?(?:实验)?(?:显示|展示|说明|呈现|提到|强调)",
    r"(?i)\b(?:the\s+)?(?:speaker|instructor|lecturer|presenter)\b.{0,48}\b(?:then|later|next|subsequently|emphasizes?|notes?|says?|points?\s+out|mentions?|explains?|shows?)\b",
    r"(?i)\b(?:in|later\s+in)\s+(?:the\s+)?(?:video|lecture|talk)\b",
    r"(?i)\b(?:the\s+)?slide\s+(?:shows?|demonstrates?|illustrates?|presents?)\b",
)
#: Patterns of what notes and pages hold, fixed values.
GENERIC_ALT = r"(?i)^(?:课件帧|幻灯片(?:截图|帧)?|slide(?:\s+frame)?|screenshot)(?:[，,\s:—-]*\d{1,2}:\d{2}(?::\d{2})?)?$"
TIMESTAMP_URL = r"(?i)https?://[^\s)>\]]+(?:[?&](?:t|start)=\d+s?)[^\s)>\]]*"
CITATION = r"\[\^(cc_[a-z0-9][a-z0-9_-]{2,80})\]"
DEFINITION = r"(?m)^\[\^(cc_[a-z0-9][a-z0-9_-]{2,80})\]:"
REMOTE_IMAGE = r"(?i)!\[[^\]]*\]\(\s*<?https?://"
ABSOLUTE_PATH = r"(?:^|[\s(])/(?:Users|home|tmp|private|var)/"
EVIDENCE_HEADING = r"(?im)^#{2,6}\s+(?:证据|Evidence)\s*$"
_DESTINATION = r'\((?:<([^>]+)>|([^)\s]+))(?:\s+"[^"]*")?\)'


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def document_stem(title: Column) -> Column:
    """A file name from a title: reserved characters out, at most 120 characters, never empty."""
    text = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    text = squeeze(F.regexp_replace(F.regexp_replace(text, ":", " -"), r'[\\/*?"<>|]', " "))
    text = F.trim(F.regexp_replace(text, r"[.\s]+$", ""))
    return F.trim(F.left(F.when(text == "", "Untitled").otherwise(text), F.lit(120)))


def language_code(value: Column) -> Column:
    text = F.left(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9_-]", "-"), F.lit(40))
    return F.when(text == "", "und").otherwise(text)


@arrow_udf("string")
def yaml_scalar(values: pd.Series) -> pd.Series:
    """A YAML plain scalar, quoted as JSON where a plain one would be read otherwise."""
    reserved = re.compile(r"(?:null|~|true|false|yes|no|on|off|[-+]?(?:\d+\.?\d*|\.\d+))", re.I)
    unsafe = re.compile(r"[\r\n]|:\s|(?:^|\s)#|^[\-?:,\[\]{}#&*!|>'\"%@`]")

    def one(x):
        text = ("" if x is None else str(x)).strip()
        if not text:
            return ""
        return json.dumps(text, ensure_ascii=False) if unsafe.search(text) or reserved.fullmatch(text) else text

    return values.map(one)


def front_matter(title: Column, author: Column, source_url: Column, published: Column, captured: Column) -> Column:
    """The five-field block, in its fixed order."""
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), yaml_scalar(title)), F.concat(F.lit("author: "), yaml_scalar(author)),
        F.concat(F.lit("source_url: "), yaml_scalar(source_url)), F.concat(F.lit("published: "), F.coalesce(published, F.lit(""))),
        F.concat(F.lit("captured: "), captured), F.lit("---"), F.lit(""),
    )


def strict_front_matter(markdown: Column) -> Column:
    """Struct of the five fields, body and problem, by expressions alone.

    problem is null where the block is right: present, five lines, the keys in order, quoted values
    valid JSON strings.
    """
    keys = ("title", "author", "source_url", "published", "captured")
    block = F.regexp_extract(markdown, r"^---\n([\s\S]*?)\n---\n", 1)
    there = markdown.rlike(r"^---\n[\s\S]*?\n---\n")
    lines = F.split(block, "\n", -1)
    fields, bad, broken = [], F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, key in reversed(list(enumerate(keys))):
        line = F.get(lines, F.lit(i))
        raw = F.trim(F.regexp_extract(line, r"^[a-z_]+:(.*)$", 1))
        quoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        is_quoted = raw.startswith('"')
        fields.append(F.when(is_quoted, quoted).otherwise(raw).alias(key))
        bad = F.when(~F.coalesce(F.regexp_extract(line, r"^([a-z_]+):", 1) == key, F.lit(False)), f"field {i + 1}").otherwise(bad)
        broken = F.when(is_quoted & quoted.isNull(), f"scalar {i + 1}").otherwise(broken)
    problem = F.when(~there, "missing").when(F.size(lines) != 5, "field count").otherwise(F.coalesce(bad, broken))
    body = F.regexp_replace(markdown, r"^---\n[\s\S]*?\n---\n", "")
    return F.struct(*reversed(fields), body.alias("body"), problem.alias("problem"))


def escape_alt(alt: Column) -> Column:
    text = F.coalesce(F.nullif(alt, F.lit("")), F.lit("Image"))
    return F.replace(F.replace(text, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


@arrow_udf("string")
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@arrow_udf("string")
def casefold(values: pd.Series) -> pd.Series:
    """Full case folding with white space collapsed: the identity of claim texts."""
    return values.map(lambda x: None if x is None else " ".join(x.casefold().split()))


def heading_text(value: Column) -> Column:
    """A heading without link wrappers, escapes and emphasis marks, in NFKC, white space collapsed."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"!\[([^\]]*)\]\((?:<[^>]+>|[^)]+)\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\((?:<[^>]+>|[^)]+)\)", "$1")
    text = F.regexp_replace(text, r"\\([\\`*_\[\]{}()#+\-.!>])", "$1")
    return squeeze(nfkc(F.regexp_replace(text, "[*_~`]", "")))


def timestamp_urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TIMESTAMP_URL), F.lit(0)))


def _destinations(text: Column, pattern: str) -> Column:
    angle = F.regexp_extract_all(text, F.lit(pattern + _DESTINATION), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(pattern + _DESTINATION), F.lit(2))
    return F.zip_with(angle, bare, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))


def image_destinations(text: Column) -> Column:
    return _destinations(text, r"!\[[^\]]*\]")


def link_destinations(text: Column, empty_label: bool = False) -> Column:
    return _destinations(text, r"(?<!!)\[[^\]]" + ("*" if empty_label else "+") + r"\]")


def code_blocks(text: Column) -> Column:
    """Array of (language, body) of backtick fences."""
    pattern = r"```([^\n]*)\n([\s\S]*?)```"
    languages = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(languages, bodies, lambda a, b: F.struct(F.trim(a).alias("language"), F.regexp_replace(b, r"\n\z", "").alias("body")))


def block_types(text: Column) -> Column:
    """Types of the blocks between blank lines, in order."""
    bare = F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n?", "")
    blocks = F.filter(F.transform(F.split(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.when(b.startswith("```"), "CODE")
        .when(b.rlike(r"^#{1,6}\s+"), F.concat(F.lit("H"), F.length(F.regexp_extract(b, r"^(#{1,6})\s", 1)).cast("string")))
        .when(b.rlike(r"^!\[[^\]]*\]\("), "IMAGE")
        .when(b.rlike(r"^>\s?"), "QUOTE")
        .when(b.rlike(r"^(?:[-+*]|\d+\.)\s+"), "LIST")
        .when(b.rlike(r"(?m)^\|.*\|$"), "TABLE")
        .when(b == "---", "RULE")
        .otherwise("PARAGRAPH"),
    )


def plain_text(text: Column) -> Column:
    """Text without fences, link wrappers, marks and white space: what two versions are compared by."""
    out = F.regexp_replace(text, r"```[\s\S]*?```", "")
    out = F.regexp_replace(out, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(out, r"[\s#>*_~`|\\-]+", "")


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{IsHan}+", ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def definitions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(1))


def evidence_parts(body: Column) -> tuple[Column, Column]:
    """The body before and after the first evidence heading."""
    at = F.regexp_instr(body, F.lit(EVIDENCE_HEADING))
    found = F.regexp_extract(body, EVIDENCE_HEADING, 0)
    before = F.when(at == 0, body).otherwise(F.substring(body, F.lit(1), at - 1))
    after = F.when(at == 0, "").otherwise(F.substring(body, at + F.length(found), F.length(body)))
    return before, after


def source_title(title: Column, stem: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(title, F.lit("")), F.replace(stem, F.lit(TRANSLATION_SUFFIX), F.lit(""))))


def pair_stem(stem: Column) -> Column:
    """The stem of the original that a translation belongs to; null for other notes."""
    return F.when(stem.endswith(TRANSLATION_SUFFIX), F.regexp_replace(stem, TRANSLATION_SUFFIX + r"\z", ""))


def fence_free_lines(body: Column) -> Column:
    """Array of (number, line) outside code fences: a fold over the lines with the open fence as state.

    A fence closes at one of its own mark that is at least as long.
    """
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("number"), x.alias("line")))
    marked = F.transform(lines, lambda x: F.struct(x["number"].alias("number"), x["line"].alias("line"), F.regexp_extract(x["line"], r"^\s*(`{3,}|~{3,})", 1).alias("mark")))

    def step(open_mark: Column, mark: Column) -> Column:
        closes = (F.left(mark, F.lit(1)) == F.left(open_mark, F.lit(1))) & (F.length(mark) >= F.length(open_mark))
        return F.when(mark == "", open_mark).when(open_mark == "", mark).when(closes, "").otherwise(open_mark)

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<number:int,line:string>>").alias("out"))
    folded = F.aggregate(
        marked,
        start,
        lambda a, x: F.struct(
            step(a["fence"], x["mark"]).alias("fence"),
            F.when((x["mark"] == "") & (a["fence"] == ""), F.concat(a["out"], F.array(F.struct(x["number"].alias("number"), x["line"].alias("line"))))).otherwise(a["out"]).alias("out"),
        ),
    )
    return folded["out"]


def style_violations(body: Column) -> Column:
    """Numbers of the lines outside fences with a forbidden heading or narration of the medium."""

    def bad(x: Column) -> Column:
        line = x["line"]
        heading = F.regexp_extract(line, r"^#{2,6}\s+(.+?)\s*#*\s*$", 1)
        bare = F.lower(squeeze(F.regexp_replace(F.regexp_replace(heading, r"\[([^\]]+)\]\((?:<[^>]+>|[^)]+)\)", "$1"), "[*_~`]", "")))
        prose = F.regexp_replace(line, r"https?://\S+", "")
        found = bare.isin(*FORBIDDEN_HEADINGS)
        for pattern in NARRATION:
            found = found | prose.rlike(pattern)
        return found

    return F.transform(F.filter(fence_free_lines(body), bad), lambda x: x["number"])


def is_generic_alt(alt: Column) -> Column:
    return alt.rlike(GENERIC_ALT)


def is_placeholder(predicate: Column) -> Column:
    return F.lower(F.trim(predicate)).isin(*PLACEHOLDERS)


def remove_first_heading(markdown: Column, title: Column) -> Column:
    """Drop the first level-one heading outside fences if it equals the title, and one empty line after it."""
    outside = F.filter(fence_free_lines(markdown), lambda x: x["line"].rlike(r"^#(?!#)\s+(.+?)\s*#*\s*$"))
    first = F.get(outside, F.lit(0))
    text = heading_text(F.regexp_extract(first["line"], r"^#(?!#)\s+(.+?)\s*#*\s*$", 1))
    lines = F.split(markdown, "\n", -1)
    n = first["number"]
    skip = F.when(F.get(lines, n) == "", 1).otherwise(0)
    cut = F.concat(F.slice(lines, F.lit(1), n - 1), F.slice(lines, n + 1 + skip, F.size(lines)))
    hit = (heading_text(title) != "") & (text == heading_text(title))
    return F.when(F.coalesce(hit & n.isNotNull(), F.lit(False)), F.array_join(cut, "\n")).otherwise(markdown)
