"""Markdown to evidence units and units to spans.

Units need a block scanner with state over lines, so they come from an Arrow UDF over whole texts.
Spans are cut from whole texts too, lines and then pieces, in one pass over Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.udf import arrow_udf

from factloom.functions.hashing import stable_id

MOST_CHARS = 6000
UNITS = "array<struct<heading_path:array<string>,start_line:int,end_line:int,content:string,timestamps:array<string>>>"
BLOCKS = "array<struct<kind:string,level:int,start:int,stop:int,text:string>>"
_STAMP = re.compile(r"https?://[^\s)>\]]+(?:[?&](?:t|start)=\d+s?)[^\s)>\]]*", re.I)
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^\n]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_HTML = re.compile(r" {0,3}<(?:(?P<raw>script|pre|style|textarea)(?=[\s>]|$)|(?P<comment>!--)|(?P<pi>\?)|(?P<decl>![A-Za-z])|/?(?:address|article|aside|base|body|blockquote|br|button|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))", re.I)
_UNMARK = re.compile(r"!?\[([^\]]*)\]\((?:<[^>]*>|[^()\s]*)(?:\s+\"[^\"]*\")?\)|[*_`~]+")


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


def blocks(text: str) -> list[tuple[str, int, int, int, str]]:
    """Top-level blocks of a CommonMark text: (kind, heading level, first line, line after, heading text).

    Kinds: heading, paragraph, list, quote, fence, code, html; thematic breaks are left out. Lists
    and quotes take lazy continuation lines; nested blocks belong to the block around them.
    """
    lines = text.splitlines()
    out: list[tuple[str, int, int, int, str]] = []
    i, n = 0, len(lines)

    def starts_block(line: str) -> bool:
        m = _ITEM.match(line)
        listed = m and (m[4] or "").strip() and (not m[2][0].isdigit() or m[2][:-1] == "1")
        html = _HTML.match(line)
        return bool(_ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or line.lstrip().startswith(">") and _indent(line) < 4 or listed or html)

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        if _indent(line) >= 4:
            while i < n and (not lines[i].strip() or _indent(lines[i]) >= 4):
                i += 1
            stop = i
            while not lines[stop - 1].strip():
                stop -= 1
            out.append(("code", 0, start, stop, ""))
            continue
        m = _ATX.match(line)
        if m:
            out.append(("heading", len(m[1]), i, i + 1, (m[2] or "").strip()))
            i += 1
            continue
        m = _FENCE.match(line)
        if m and not (m[2][0] == "`" and "`" in m[3]):
            i += 1
            while i < n and not re.match(r" {0,3}%s{%d,}[ \t]*$" % (re.escape(m[2][0]), len(m[2])), lines[i]):
                i += 1
            i = min(n, i + 1)
            out.append(("fence", 0, start, i, ""))
            continue
        if _RULE.match(line):
            i += 1
            continue
        m = _HTML.match(line)
        if m:
            ends = {"raw": r"</(?:script|pre|style|textarea)>", "comment": "-->", "pi": r"\?>", "decl": ">"}
            kind = next((k for k in ends if m[k]), None)
            while i < n and (kind or lines[i].strip()):
                i += 1
                if kind and re.search(ends[kind], lines[i - 1], re.I):
                    break
            out.append(("html", 0, start, i, ""))
            continue
        m = _ITEM.match(line)
        if line.lstrip().startswith(">"):
            para = True
            while i < n and lines[i].strip():
                quoted = lines[i].lstrip().startswith(">") and _indent(lines[i]) < 4
                if not quoted and (not para or starts_block(lines[i])):
                    break
                para = bool(lines[i].lstrip().lstrip(">").strip()) and not _FENCE.match(lines[i].lstrip().lstrip("> "))
                i += 1
            out.append(("quote", 0, start, i, ""))
            continue
        if m:
            mark = m[2][-1]
            width = len(m[1]) + len(m[2]) + (1 if m[3] is None or len(m[3].expandtabs(4)) > 4 else len(m[3]))
            stop, blank, i = start + 1, False, start + 1
            while i < n:
                line = lines[i]
                if not line.strip():
                    blank = True
                    i += 1
                    continue
                item = _ITEM.match(line)
                if _indent(line) >= width:
                    pass
                elif item and item[2][-1] == mark and not _RULE.match(line):
                    width = len(item[1]) + len(item[2]) + (1 if item[3] is None or len(item[3].expandtabs(4)) > 4 else len(item[3]))
                elif blank or starts_block(line):
                    break
                blank = False
                i += 1
                stop = i
            i = stop
            out.append(("list", 0, start, stop, ""))
            continue
        i += 1
        level = 0
        while i < n and lines[i].strip():
            under = _SETEXT.match(lines[i])
            if under:
                level = 1 if under[1][0] == "=" else 2
                i += 1
                break
            if _indent(lines[i]) < 4 and starts_block(lines[i]):
                break
            i += 1
        if level:
            out.append(("heading", level, start, i, "\n".join(x.strip() for x in lines[start : i - 1])))
        else:
            out.append(("paragraph", 0, start, i, ""))
    return out


def _stamps(text: str) -> list[str]:
    return list(dict.fromkeys(_STAMP.findall(text)))


def units(body: str, body_line: int, most: int = MOST_CHARS) -> list[tuple]:
    """(heading path, first line, last line, content, timestamps) of the evidence units of a body.

    A heading of level k replaces what stands at depth k and below in the path, by position, so that
    a skipped level nests. Neighbouring blocks merge under one path and equal inherited timestamps,
    across at most one line, while the text stays within ``most`` characters.
    """
    lines = body.splitlines()
    path: list[str] = []
    stamps: list[list[str]] = []
    spans: list[list] = []
    for kind, level, start, stop, text in blocks(body):
        if kind == "heading":
            path, stamps = path[: level - 1], stamps[: level - 1]
            plain = _UNMARK.sub(lambda m: m[1] or "", text).strip()
            path.append(plain or text.strip())
            stamps.append(_stamps("\n".join(lines[start:stop])))
            continue
        shown = [p for p in path if p]
        inherited = list(dict.fromkeys(u for group in stamps for u in group))
        if spans:
            last = spans[-1]
            if last[2] == shown and last[3] == inherited and start <= last[1] + 1 and len("\n".join(lines[last[0] : stop])) <= most:
                last[1] = stop
                continue
        spans.append([start, stop, shown, inherited])
    out = []
    for start, stop, shown, inherited in spans:
        content = "\n".join(lines[start:stop])
        if content.strip():
            out.append((shown, body_line + start, body_line + stop - 1, content, list(dict.fromkeys(inherited + _stamps(content)))))
    return out


@arrow_udf(UNITS)
def units_of(bodies: pd.Series, body_lines: pd.Series) -> pd.Series:
    names = ("heading_path", "start_line", "end_line", "content", "timestamps")
    return pd.Series([[dict(zip(names, u)) for u in units(b or "", int(at))] for b, at in zip(bodies, body_lines)])


@arrow_udf(BLOCKS)
def blocks_of(bodies: pd.Series) -> pd.Series:
    def one(body):
        lines = (body or "").splitlines()
        return [
            {"kind": k, "level": v, "start": s, "stop": e, "text": t if k == "heading" else "\n".join(lines[s:e])} for k, v, s, e, t in blocks(body or "")
        ]

    return pd.Series([one(b) for b in bodies])


def evidence_units(sources: DataFrame) -> DataFrame:
    """Unit rows from (source_id, path, source_url, body, body_line)."""
    each = sources.select("source_id", F.col("path").alias("variant_path"), "source_url", F.explode(units_of("body", "body_line")).alias("u"))
    digest = F.sha2("u.content", 256)
    url = F.when(F.coalesce("source_url", F.lit("")) != "", F.array(F.struct(F.lit("url").alias("type"), F.col("source_url").alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    marks = F.transform("u.timestamps", lambda v: F.struct(F.lit("timestamp").alias("type"), v.alias("value")))
    return each.select(
        stable_id("eu", F.col("source_id"), F.col("variant_path"), F.col("u.start_line"), F.col("u.end_line"), digest).alias("evidence_unit_id"),
        "source_id", "variant_path", "u.heading_path", "u.start_line", "u.end_line", digest.alias("content_sha256"), "u.content",
        F.concat(url, marks).alias("upstream_locators"),
    )


_MARK = re.compile(r"(?:[-+*]|\d+[.)])\s+", re.A)
#: Where a sentence ends; the last alternative is a line end that splitting at \r and \n leaves on a line. A set of
#: characters comes first, which the engine finds several times as fast as it tries alternatives at each place.
_STOP = re.compile(r"[。！？；.!?](?:(?<=[。！？；])|(?=\s|\Z|[\x85\u2028\u2029]\Z))", re.A)
_SPACE = " \t\n\x0b\x0c\r"
#: Texts cut at once.
_TEXTS = 256


def _begins(lengths: pa.Array) -> pa.Array:
    """Running sums within each list, before each element: one pass over all lists of a batch."""
    ends = lengths.offsets.to_numpy().astype("int64") - lengths.offsets[0].as_py()
    before = np.append(0, np.cumsum(lengths.flatten().to_numpy()))
    sums = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(sums.astype("int32")))


def _kind(line: str, text: str, listed: bool) -> str:
    if text.startswith("!["):
        return "media"
    if text.startswith("[") and "](" in text:
        return "link"
    if text.startswith(("```", "~~~")) or (line.startswith("    ") and not listed):
        return "code"
    return "table-row" if text.count("|") >= 2 else "list-item" if listed else "prose"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_text, _first, ...) to (line, start, end, content, kind, ...) of each span; _text is UTF-8."""
    for whole in batches:
        for low in range(0, whole.num_rows, _TEXTS):
            b = whole.slice(low, _TEXTS)
            # a line begins where str.splitlines cuts
            lines = [t.decode("utf-8", "replace").splitlines(True) for t in b.column("_text").to_pylist()]
            begins = _begins(pa.array([[len(x) for x in found] for found in lines], pa.list_(pa.int32()))).to_pylist()
            # of a line: text, place, offset, kind and number of its spans; of a span: content and where it ends in the line
            owner, place, offsets, kinds, counts, contents, ends = [], [], [], [], [], [], []
            for row, (found, ats) in enumerate(zip(lines, begins)):
                for i, (raw, at) in enumerate(zip(found, ats)):
                    line = raw.rstrip("\r\n")
                    bare = line.lstrip(_SPACE)
                    mark = _MARK.match(bare)
                    text = bare[mark.end() :] if mark else bare
                    if not text:
                        continue
                    stops = [m.end() for m in _STOP.finditer(text)]
                    contents += [text[begin:end].lstrip(_SPACE) for begin, end in zip([0, *stops], stops)]
                    left = text[stops[-1] if stops else 0 :].strip(_SPACE)
                    if left:
                        contents.append(left)
                        stops.append(len(text.rstrip(_SPACE)))
                    if stops:
                        owner.append(row)
                        place.append(i)
                        offsets.append(at + len(line) - len(text))
                        kinds.append(_kind(line, text, mark is not None))
                        counts.append(len(stops))
                        ends += stops
            of = np.repeat(np.arange(len(counts)), np.array(counts, "int64"))
            content = pa.array(contents, pa.string())
            stop = pa.array(np.array(offsets, "int64")[of] + np.array(ends, "int64"))
            first = b.column("_first").take(pa.array(owner, pa.int64()))
            rest = [n for n in b.schema.names if n not in ("_text", "_first")]
            columns = [pc.add(first, pa.array(place, pa.int64())).take(pa.array(of)), pc.subtract(stop, pc.utf8_length(content).cast("int64")), stop, content, pa.array(kinds, pa.string()).take(pa.array(of))]
            of = pa.array(np.array(owner, "int64")[of])
            yield pa.RecordBatch.from_arrays([*columns, *(b.column(n).take(of) for n in rest)], names=["line", "start_offset", "end_offset", "content", "span_kind", *rest])


def span_rows(units: DataFrame, unit_id: str, content: str, start_line: Column, *also: str) -> DataFrame:
    """(evidence_unit_id, start_offset, end_offset, line, content, span_kind) of each span of a unit.

    Every line with text gives one or more exact substrings: indentation and list marks go, what is
    left is cut after sentence ends. Offsets count code points in the unit's text; a text is cut in one
    pass where it lies, so nothing is shuffled. also: further columns of the unit that its spans keep.
    """
    texts = units.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("_text"), start_line.cast("long").alias("_first"), F.col(unit_id).alias("evidence_unit_id"), *also)
    made = StructType().add("line", "long").add("start_offset", "long").add("end_offset", "long").add("content", "string").add("span_kind", "string")
    rows = texts.mapInArrow(_cut, StructType(made.fields + texts.schema.fields[2:]))
    return rows.select("evidence_unit_id", "start_offset", "end_offset", "line", "content", "span_kind", *also)


def evidence_spans(units: DataFrame) -> DataFrame:
    """Span rows with ids from evidence units."""
    rows = span_rows(units, "evidence_unit_id", "content", F.col("start_line"))
    digest = F.sha2("content", 256)
    return rows.select(
        stable_id("es", F.col("evidence_unit_id"), F.col("start_offset"), F.col("end_offset"), digest).alias("evidence_span_id"),
        "evidence_unit_id", "start_offset", "end_offset", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        digest.alias("content_sha256"), "content", "span_kind",
    )


def primary_anchors(units: DataFrame, sources: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Anchors of derived notes: one for each timestamp locator of their units.

    assets: (source_id, local_asset_path, local_asset_sha256) of transcripts kept beside a note; an
    anchor is available where its source has one.
    """
    notes = sources.where("evidence_tier = 'derived-note'").select("source_id").distinct()
    named = units.join(notes, "source_id", "left_semi").select("source_id", "evidence_unit_id", F.explode("upstream_locators").alias("l")).where("l.type = 'timestamp'")
    none = F.lit(None).cast("string")
    if assets is None:
        met = named.select("*", none.alias("local_asset_path"), none.alias("local_asset_sha256"))
    else:
        met = named.join(assets.select("source_id", "local_asset_path", "local_asset_sha256"), "source_id", "left")
    return met.select(
        stable_id("pa", F.col("evidence_unit_id"), F.col("l.value")).alias("primary_anchor_id"), "source_id", "evidence_unit_id", F.lit("video-timestamp").alias("anchor_type"), F.col("l.value").alias("locator"),
        "local_asset_path", "local_asset_sha256", F.when(F.col("local_asset_path").isNotNull(), "available").otherwise("unavailable").alias("verification_status"),
    )


def factual_blocks(pages: DataFrame, page_id: str, body: str) -> DataFrame:
    """(page_id, ordinal, text) of paragraphs, those in lists and quotes too, before the first
    evidence or open-questions heading, but for those that begin with a bracket."""
    stop = r"(?i)^(证据|Evidence|开放问题|Open questions)$"
    rows = pages.select(F.col(page_id).alias("page_id"), F.posexplode(blocks_of(F.col(body))).alias("ordinal", "b"))
    ends = rows.where((F.col("b.kind") == "heading") & F.col("b.text").rlike(stop)).groupBy("page_id").agg(F.min("ordinal").alias("end"))
    said = rows.where(F.col("b.kind").isin("paragraph", "list", "quote")).join(ends, "page_id", "left").where(F.col("end").isNull() | (F.col("ordinal") < F.col("end")))
    return said.select("page_id", "ordinal", F.trim("b.text").alias("text")).where(~F.col("text").startswith("[") & (F.col("text") != ""))
