"""Frames and slides: luma signatures, quality, stable segments, bounds, duplicate collapse.

Frames come as rows. Per-frame arithmetic is numpy in Arrow UDFs; order within a video is window
functions; only the greedy collapse, whose state is what it has kept, runs a video at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

#: Thresholds of the slide rules, fixed values.
SAME_MEAN, SAME_MEAN_CHANGED, SAME_CHANGED, CHANGED_BY = 0.8, 2.4, 0.04, 14
LEAST_SAMPLES, REPRESENTATIVES = 2, 3
ASPECTS = (4 / 3, 3 / 2, 16 / 10, 16 / 9)
SIGNATURE = (96, 54)
QUALITY = "struct<border_luma_deficit:double,contrast:double,dark_border_ratio:double,mean_luma:double,score:double,sharpness:double>"
#: Thresholds of the rectangle search, fixed values.
DARKER, LEAST_SIDE, LEAST_AREA, MOST_AREA, ASPECT_ERROR, LEAST_CONFIDENCE = 28, 0.35, 0.55, 0.985, 0.055, 0.62
DIFFERENCE = "struct<changed_ratio:double,mean_difference:double>"
BOUNDS = "struct<confidence:double,height:int,width:int,x:int,y:int>"


def _image(raw, width: int, height: int) -> np.ndarray:
    return np.frombuffer(bytes(raw), np.uint8).reshape(height, width, -1).astype(np.float64)


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def luma_signature(raw, width: int, height: int, step: int = 2) -> np.ndarray:
    """Rounded luma of every step-th pixel both ways."""
    rgb = _image(raw, width, height)[::step, ::step]
    return _half_up(rgb @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def quality(luma: np.ndarray) -> tuple:
    """Deficit, contrast, dark border, mean, score and sharpness of a luma image."""
    v = luma.astype(np.float64)
    h, w = v.shape
    across, down = np.abs(np.diff(v, axis=1)), np.abs(np.diff(v, axis=0))
    n = across.size + down.size
    sharp = (across.sum() + down.sum()) / n if n else 0.0
    border = np.ones((h, w), bool)
    bw, bh = max(1, int(w * 0.06)), max(1, int(h * 0.06))
    border[bh : h - bh, bw : w - bw] = False
    edge, inner = v[border], v[~border]
    mean = v.mean()
    deficit = max(0.0, ((inner.mean() if inner.size else mean) - (edge.mean() if edge.size else mean)) / 255)
    contrast = max(0.0, (v * v).mean() - mean * mean) ** 0.5
    saturated = ((v <= 5) | (v >= 250)).mean()
    score = 1.6 * sharp + 0.1 * contrast - 60 * deficit - 0.5 * saturated
    return round(deficit, 4), round(contrast, 3), round(float((edge < 32).mean()) if edge.size else 0.0, 4), round(mean, 3), round(score, 3), round(sharp, 3)


def describe(width: int, height: int, step: int = 2):
    """UDF: raw RGB frame to (signature, quality); a frame of another size gives null."""

    @arrow_udf(f"struct<signature:binary,quality:{QUALITY}>")
    def udf(frames: pd.Series) -> pd.DataFrame:
        names = ["border_luma_deficit", "contrast", "dark_border_ratio", "mean_luma", "score", "sharpness"]
        rows = []
        for raw in frames:
            if raw is None or len(raw) != width * height * 3:
                rows.append((None, None))
                continue
            luma = luma_signature(raw, width, height, step)
            rows.append((luma.tobytes(), dict(zip(names, map(float, quality(luma))))))
        return pd.DataFrame(rows, columns=["signature", "quality"])

    return udf


def difference(a: Column, b: Column) -> Column:
    """Mean absolute difference and share of values that differ by more than 14, of two arrays.

    Missing arrays and other lengths differ in full: (1, 255).
    """
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    n = F.size(a)
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    changed = F.size(F.filter(gaps, lambda x: x > CHANGED_BY))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(fits, F.struct((changed / n).alias("changed_ratio"), (total / n).alias("mean_difference"))).otherwise(F.struct(F.lit(1.0).alias("changed_ratio"), F.lit(255.0).alias("mean_difference")))


@arrow_udf(DIFFERENCE)
def byte_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The same for byte signatures."""

    def one(x, y):
        if x is None or y is None or len(x) != len(y) or not len(x):
            return 1.0, 255.0
        d = np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8))
        return float((d > CHANGED_BY).mean()), float(d.mean())

    return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["changed_ratio", "mean_difference"])


def is_same(diff: Column) -> Column:
    mean, changed = diff["mean_difference"], diff["changed_ratio"]
    return (mean <= SAME_MEAN) | ((mean <= SAME_MEAN_CHANGED) & (changed <= SAME_CHANGED))


def frame_runs(frames: DataFrame, video: str, at: str, signature: str, diff=difference) -> DataFrame:
    """frames with run (its first frame's number) and diff to the frame before in the same video."""
    order = Window.partitionBy(video).orderBy(at)
    before = frames.withColumn("before", F.lag(signature).over(order))
    compared = before.withColumn("diff", diff(F.col("before"), F.col(signature)))
    starts = F.when(F.col("before").isNull() | ~is_same(F.col("diff")), 1).otherwise(0)
    return compared.withColumn("run", F.sum(starts).over(order)).drop("before")


def representatives(runs: DataFrame, video: str, at: str, score: str) -> DataFrame:
    """Up to three frames of each stable segment, best first: (video, segment, place, at, rank_score, ...).

    A run of one frame is no segment; segments are numbered afterwards. A frame's rank is its score
    less twice its smaller difference to a neighbour in the run, less a half at the ends of runs of
    three and more.
    """
    inside = Window.partitionBy(video, "run").orderBy(at)
    whole = Window.partitionBy(video, "run")
    mean = F.col("diff.mean_difference")
    n, i = F.count("*").over(whole), F.row_number().over(inside)
    marked = runs.select(video, "run", F.col(at).alias("at"), F.col(score).alias("score"), n.alias("sample_count"), i.alias("i"), F.when(i > 1, mean).alias("prev"), F.lead(mean).over(inside).alias("next"), F.min(at).over(whole).alias("start_seconds"), F.max(at).over(whole).alias("end_seconds"))
    kept = marked.where(F.col("sample_count") >= LEAST_SAMPLES)
    edge = (F.col("sample_count") > 2) & ((F.col("i") == 1) | (F.col("i") == F.col("sample_count")))
    rank = F.round(F.col("score") - 2 * F.least("prev", "next") - F.when(edge, 0.5).otherwise(0.0), 3)
    best = Window.partitionBy(video, "run").orderBy(F.desc("rank_score"), "at")
    ranked = kept.withColumn("rank_score", rank).withColumn("place", F.row_number().over(best)).withColumn("segment", F.dense_rank().over(Window.partitionBy(video).orderBy("run")))
    return ranked.where(F.col("place") <= REPRESENTATIVES).select(video, "segment", "place", "at", "rank_score", "sample_count", "start_seconds", "end_seconds")


def segment_name(segment: Column) -> Column:
    return F.format_string("segment-%04d", segment)


def difference_hash(signature: Column, width: int = SIGNATURE[0], height: int = SIGNATURE[1]) -> Column:
    """16 hex digits: whether a sample of a row is brighter than its right neighbour, 8 by 8 of a grid
    of 9 by 8, of a row-major luma array."""
    bits = []
    for row in range(8):
        y = min(height - 1, int((row + 0.5) * height / 8))
        for column in range(8):
            left, right = (min(width - 1, int((column + k) * width / 9)) for k in (0.5, 1.5))
            bits.append((signature[y * width + left] > signature[y * width + right]).cast("int").cast("string"))
    nibbles = [F.lower(F.conv(F.concat(*bits[i : i + 4]), 2, 16)) for i in range(0, 64, 4)]
    return F.concat(*nibbles)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; halves keep within the range of longs."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return sum(F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9))


def ocr_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; zero if either has fewer than four."""
    x, y = ocr_tokens(a), ocr_tokens(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small < 4, 0.0).otherwise(F.size(F.array_intersect(x, y)) / small)


def ocr_text(words: DataFrame, frame: str) -> DataFrame:
    """(frame, confident_text, line_count, word_count) from OCR word rows with confidence of 30 or more.

    words: (frame, place, page, block, par, line, confidence, text).
    """
    sure = words.where((F.col("confidence") >= 30) & (F.trim("text") != ""))
    told = F.sort_array(F.collect_list(F.struct("place", F.trim("text").alias("t"))))
    return sure.groupBy(frame).agg(
        F.left(F.array_join(F.transform(told, lambda x: x["t"]), " "), F.lit(4000)).alias("confident_text"),
        F.count_distinct("page", "block", "par", "line").alias("line_count"), F.count("*").alias("word_count"),
    )


def resample(raw, width: int, height: int, bounds: tuple[int, int, int, int], size: tuple[int, int] = SIGNATURE) -> np.ndarray:
    """Luma at the centres of a size grid over (x, y, width, height) of a frame."""
    x0, y0, w, h = bounds
    xs = np.minimum(width - 1, (x0 + (np.arange(size[0]) + 0.5) * w / size[0]).astype(int))
    ys = np.minimum(height - 1, (y0 + (np.arange(size[1]) + 0.5) * h / size[1]).astype(int))
    rgb = _image(raw, width, height)[np.ix_(ys, xs)]
    return _half_up(rgb @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def resampled(width: int, height: int, bounds: tuple[int, int, int, int], size: tuple[int, int] = SIGNATURE):
    """UDF: raw RGB frame to its signature within bounds; a frame of another size gives null."""

    @arrow_udf("binary")
    def udf(frames: pd.Series) -> pd.Series:
        return frames.map(lambda raw: None if raw is None or len(raw) != width * height * 3 else resample(raw, width, height, bounds, size).tobytes())

    return udf


def scan(streams: DataFrame, key: str, raw: str, frame_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(frames, violations) of raw streams: (key, number, frame) of each whole frame; streams that are
    empty or end within a frame are refused."""
    from factloom.operators.rules import union, violations

    size = F.octet_length(raw)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"octet_length({raw}) div {frame_bytes} - 1").cast("int")), lambda i: F.substring(F.col(raw), i * frame_bytes + 1, F.lit(frame_bytes)))
    frames = streams.where(size >= frame_bytes).select(key, F.posexplode(cut).alias("number", "frame"))
    return frames, union(
        violations(streams, "NO_FRAMES", F.col(key), F.coalesce(size, F.lit(0)) == 0),
        violations(streams, "TRUNCATED_FRAME", F.col(key), size % frame_bytes != 0, size % frame_bytes),
    )


def boundary_scores(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute RGB difference at each boundary between rows and between columns; every other
    pixel along the boundary counts, the frame's own edges are zero."""
    h, w, _ = rgb.shape
    rows, columns = np.zeros(h + 1), np.zeros(w + 1)
    rows[1:h] = np.abs(np.diff(rgb, axis=0)).sum(axis=2)[:, ::2].mean(axis=1)
    columns[1:w] = np.abs(np.diff(rgb, axis=1)).sum(axis=2)[::2].mean(axis=0)
    return rows, columns


def strong_edges(scores: np.ndarray, most: int = 24) -> list[tuple[int, float]]:
    """(position, strength) of local maxima of at least 18 and 0.18 of the largest, strongest first,
    at least four apart, at most ``most``."""
    top = scores.max()
    if top < 18:
        return []
    padded = np.pad(scores, 2, constant_values=-np.inf)
    around = np.max([padded[k : k + len(scores)] for k in (0, 1, 3, 4)], axis=0)
    at = np.flatnonzero((scores >= max(18, top * 0.18)) & (scores >= around))
    at = at[(at > 0) & (at < len(scores) - 1)]
    out: list[tuple[int, float]] = []
    for p in at[np.argsort(-scores[at], kind="stable")]:
        if all(abs(q - p) >= 4 for q, _ in out):
            out.append((int(p), float(scores[p] / top)))
            if len(out) == most:
                break
    return out


def slide_bounds(raw, width: int, height: int) -> tuple | None:
    """(confidence, height, width, x, y) of the slide in a frame, or None to keep the whole frame.

    Pairs of vertical and of horizontal edges, the frame's own among them, span rectangles. One is a
    slide if it is large, of a usual aspect, has three detected edges, and is darker outside at
    three of them. All rectangles are tried at once, cheap tests before pixel sums.
    """
    rgb = _image(raw, width, height)
    rows, columns = boundary_scores(rgb)
    xs = sorted([(0, 0.0, True), *((p, s, False) for p, s in strong_edges(columns)), (width, 0.0, True)])
    ys = sorted([(0, 0.0, True), *((p, s, False) for p, s in strong_edges(rows)), (height, 0.0, True)])
    luma = rgb @ np.array([0.2126, 0.7152, 0.0722])
    band = max(6, int(min(width, height) * 0.015))
    inset = max(2, band // 4)

    def mean(x0, y0, x1, y1):
        x0, y0 = max(0, min(width, x0)), max(0, min(height, y0))
        part = luma[y0 : max(y0, min(height, y1)) : 2, x0 : max(x0, min(width, x1)) : 2]
        return part.mean() if part.size else None

    def darker(outer, inner):
        return outer is not None and inner is not None and inner - outer >= DARKER

    wide = [(a, b) for i, a in enumerate(xs) for b in xs[i + 1 :] if b[0] - a[0] >= width * LEAST_SIDE]
    tall = [(a, b) for i, a in enumerate(ys) for b in ys[i + 1 :] if b[0] - a[0] >= height * LEAST_SIDE]
    best = None
    for left, right in wide:
        for top, bottom in tall:
            w, h = right[0] - left[0], bottom[0] - top[0]
            area = w * h / (width * height)
            if not LEAST_AREA <= area <= MOST_AREA:
                continue
            error = min(abs(np.log(w / h / a)) for a in ASPECTS)
            found = [e for e in (left, right, top, bottom) if not e[2]]
            if error > ASPECT_ERROR or len(found) < 3:
                continue
            (l, r), (t, b) = (left[0], right[0]), (top[0], bottom[0])
            dark = sum((
                not left[2] and darker(mean(l - band, t, l - inset, b), mean(l + inset, t, l + band, b)),
                not right[2] and darker(mean(r + inset, t, r + band, b), mean(r - band, t, r - inset, b)),
                not top[2] and darker(mean(l, t - band, r, t - inset), mean(l, t + inset, r, t + band)),
                not bottom[2] and darker(mean(l, b + inset, r, b + band), mean(l, b - band, r, b - inset)),
            ))
            if dark < 3:
                continue
            strength, aspect = sum(e[1] for e in found) / len(found), 1 - error / ASPECT_ERROR
            confidence = 0.55 * strength + 0.35 * aspect + 0.1 * area
            points = 2 * strength + 3 * aspect + 0.8 * area + 0.12 * len(found)
            if confidence >= LEAST_CONFIDENCE and (best is None or points > best[0]):
                best = points, (round(float(confidence), 3), h, w, l, t)
    return best and best[1]


def bounds_of(width: int, height: int, frame=lambda raw: raw):
    """A function of a column; frame makes the raw frame of a value, say of a compressed image. One frame at a
    time is held, as a batch of them would take gigabytes."""
    @arrow_udf(BOUNDS)
    def udf(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([slide_bounds(frame(v), width, height) or (None,) * 5 for v in values], columns=["confidence", "height", "width", "x", "y"])

    return udf


def crop_box(bounds: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """Bounds of a scaled frame in the full one: even start below, even end above, within the frame."""
    even = lambda c: F.greatest(F.floor(c / 2) * 2, F.lit(0)).cast("int")
    upto = lambda c, most: F.least(even(most), (F.ceil(c / 2) * 2).cast("int"))
    x, y = even(bounds["x"] * scale_x), even(bounds["y"] * scale_y)
    right, bottom = upto((bounds["x"] + bounds["width"]) * scale_x, width), upto((bounds["y"] + bounds["height"]) * scale_y, height)
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"), F.round((right - x) * (bottom - y) / (width * height), 4).alias("area_ratio"))


def decide(a: dict, b: dict) -> tuple[bool, str] | None:
    """(whether the later is preferred, reason) if two captures within 60 s show one slide."""
    gap = b["at"] - a["at"]
    if not 0 <= gap <= 60:
        return None
    x, y = (np.frombuffer(s["signature"], np.uint8).astype(np.int16) for s in (a, b))
    mean = float(np.abs(x - y).mean()) if len(x) == len(y) and len(x) else float("inf")
    exact = (int(a["dhash"], 16) ^ int(b["dhash"], 16)).bit_count() <= 2 and mean <= 1.5
    left, right = set(a["tokens"]), set(b["tokens"])
    small = min(len(left), len(right))
    overlap = len(left & right) / small if small >= 4 else 0.0
    border = abs((a["deficit"] or 0) - (b["deficit"] or 0))
    clearer = overlap >= 0.85 and (a["cropped"] != b["cropped"] or border >= 0.08) and (border >= 0.08 or abs(a["score"] - b["score"]) >= 2.5)
    if not exact and not clearer:
        return None
    later = (b["deficit"] or 0) < (a["deficit"] or 0) if clearer and border >= 0.08 else b["score"] > a["score"]
    return later, "visual_duplicate" if exact else "clearer_capture"


def collapse_one(candidates: list[dict]) -> list[dict]:
    """Greedy collapse in time order; each kept one lists the names of those it stands for."""
    kept: list[dict] = []
    for c in candidates:
        match = None
        for i in range(len(kept) - 1, -1, -1):
            if c["at"] - kept[i]["at"] > 60:
                break
            found = decide(kept[i], c)
            if found and (i == len(kept) - 1 or found[1] == "clearer_capture"):
                match = i, *found
                break
        if match is None:
            kept.append({**c, "alternates": []})
        else:
            i, later, _ = match
            old = kept[i]
            kept[i] = {**c, "alternates": [*old["alternates"], old["name"]]} if later else {**old, "alternates": [*old["alternates"], c["name"]]}
    return sorted(kept, key=lambda k: k["at"])


def collapse(candidates: DataFrame, video: str) -> DataFrame:
    """(video, name, at, score, alternates) of kept candidates; a video's candidates form one group.

    candidates: (video, name, at, signature, dhash, tokens, score, deficit, cropped). A video has at
    most a few thousand, by the candidate limit.
    """
    kind = candidates.schema[video].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = collapse_one(pdf.sort_values("at", kind="stable").to_dict("records"))
        return pd.DataFrame([(key[0], k["name"], k["at"], k["score"], k["alternates"]) for k in kept], columns=[video, "name", "at", "score", "alternates"])

    return candidates.groupBy(video).applyInPandas(run, f"{video} {kind}, name string, at double, score double, alternates array<string>")


def sheet_names(kept: DataFrame, video: str, at: str = "at", per_sheet: int = 16) -> DataFrame:
    """kept with number, file name and contact sheet, in time order."""
    from factloom.functions.timecode import file_clock

    n = F.row_number().over(Window.partitionBy(video).orderBy(at))
    named = kept.withColumn("number", n)
    return named.withColumn("file", F.concat(F.format_string("%03d-", "number"), file_clock(F.col(at)), F.lit(".jpg"))).withColumn("sheet", F.format_string("sheet-%03d.jpg", F.floor((F.col("number") - 1) / per_sheet) + 1))


def duration_fits(measured: Column, stated: Column) -> Column:
    return F.abs(measured - stated) <= F.greatest(F.lit(5.0), stated * 0.03)
