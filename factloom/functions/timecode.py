"""Clock, date and caption time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(seconds: Column) -> Column:
    return F.greatest(F.floor(F.coalesce(seconds.cast("double"), F.lit(0.0))), F.lit(0)).cast("long")


#: File names of slides, a fixed value.
SLIDE_NAME = r"(?i)^\d{3,}-(\d{2})h(\d{2})m(\d{2})s\.(?:jpe?g|png|webp)$"


def clock(seconds: Column, template: str = "%02d:%02d:%02d") -> Column:
    """HH:MM:SS of seconds, floored, never negative; hours may have more than two digits."""
    s = _whole(seconds)
    return F.format_string(template, F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def file_clock(seconds: Column) -> Column:
    return clock(seconds, "%02dh%02dm%02ds")


def slide_seconds(path: Column) -> Column:
    """Seconds in a slide's file name; null where the name has none or minutes or seconds exceed 59."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    part = [F.regexp_extract(name, SLIDE_NAME, i).try_cast("int") for i in (1, 2, 3)]
    return F.when((part[1] <= 59) & (part[2] <= 59), part[0] * 3600 + part[1] * 60 + part[2])


def published_date(value: Column, compact: bool = False) -> Column:
    """The leading YYYY-MM-DD, or with compact a whole YYYYMMDD; empty otherwise."""
    dashed = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\d{4}-\d{2}-\d{2}", 0)
    if not compact:
        return dashed
    return F.when(value.rlike(r"^\d{8}$"), F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(dashed)


def local_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def caption_seconds(value: Column) -> Column:
    """[hh:]mm:ss.mmm or with a comma, as seconds; null where it is neither."""
    pattern = r"^(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})$"
    text = F.trim(value)
    part = [F.coalesce(F.regexp_extract(text, pattern, i).try_cast("double"), F.lit(0.0)) for i in range(1, 5)]
    return F.when(text.rlike(pattern), F.round(part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000, 3))


def caption_clock(seconds: Column) -> Column:
    """hh:mm:ss.mmm, rounded to milliseconds."""
    ms = F.greatest(F.round(seconds * 1000), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor((ms % 3600000) / 60000), F.floor((ms % 60000) / 1000), ms % 1000)
