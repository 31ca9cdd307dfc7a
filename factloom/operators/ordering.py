"""Computations over order: monotone links, nearest neighbours, preferences, subsequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_breaks(links: DataFrame, note: str, position: str, seconds: str, duration: str | None = None, slack: float = 5.0) -> DataFrame:
    """Links that go back in time, or beyond the duration by more than the slack, with why."""
    before = F.lag(seconds).over(Window.partitionBy(note).orderBy(position))
    late = F.lit(False) if duration is None else F.col(seconds) > F.col(duration) + slack
    why = F.when(F.col("before") > F.col(seconds), "backwards").when(late, "beyond duration")
    return links.withColumn("before", before).withColumn("why", why).where("why IS NOT NULL").drop("before")


def nearest(marks: DataFrame, note: str, position: str, seconds: str, is_query: str) -> DataFrame:
    """For each query mark, the seconds of the last other mark before it and of the first after it.

    One table holds both kinds, so an as-of join needs one sort and no join.
    """
    other = F.when(~F.col(is_query), F.col(seconds))
    up = Window.partitionBy(note).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(note).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    found = marks.withColumn("preceding", F.last(other, ignorenulls=True).over(up)).withColumn("following", F.first(other, ignorenulls=True).over(down))
    return found.where(F.col(is_query))


def misplaced(found: DataFrame, seconds: str, slack: float = 5.0) -> DataFrame:
    """Images whose preceding timestamp is missing or later, or whose following one is earlier, by more than the slack."""
    early = F.col("preceding").isNull() | (F.col("preceding") > F.col(seconds) + slack)
    late = F.col("following").isNotNull() & (F.col("following") < F.col(seconds) - slack)
    return found.where(early | late)


def choose_tracks(tracks: DataFrame, wanted: DataFrame, video: str) -> DataFrame:
    """(video, language, source): the best caption track of each video.

    tracks: (video, source, language, ordinal); wanted: (video, language, preference). Manual tracks
    come before automatic ones; within a kind the earliest wanted language decides, exact before a
    prefix with a hyphen; with no match the first track. Live chats are no captions.
    """
    usable = tracks.where("language != 'live_chat'").withColumn("kind", F.when(F.col("source") == "manual_caption", 0).otherwise(1))
    w = wanted.select(video, F.lower("language").alias("want"), "preference").where("want != ''")
    low = F.lower("language")
    met = usable.join(w, video, "left")
    fit = F.when(low == F.col("want"), 0).when(low.startswith(F.concat("want", F.lit("-"))), 1)
    rank = F.struct("kind", F.when(fit.isNotNull(), F.col("preference")).otherwise(1 << 30).alias("preference"), F.coalesce(fit, F.lit(9)).alias("fit"), "ordinal")
    best = met.groupBy(video).agg(F.min_by(F.struct("language", "source"), rank).alias("t"))
    return best.select(video, "t.language", "t.source")


def equal_sequences(a: DataFrame, b: DataFrame, key: str, item: str, position: str) -> DataFrame:
    """(key, equal): whether both tables list the same items in the same order for a key."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        items = F.transform(F.sort_array(F.collect_list(F.struct(position, item))), lambda x: x[item])
        return df.groupBy(key).agg(items.alias(name))

    both = listed(a, "left").join(listed(b, "right"), key, "full_outer")
    return both.select(key, F.col("left").eqNullSafe(F.col("right")).alias("equal"))
