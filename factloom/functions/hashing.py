"""Content-addressed identity: digests, stable ids, canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

SEPARATOR = "\x1f"


def sha256(col: Column) -> Column:
    """Hex SHA-256 of a string (UTF-8) or binary column."""
    return F.sha2(col, 256)


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """``prefix_`` and the first hex digits of the SHA-256 of the parts, joined by U+001F.

    A null part counts as empty, so that ids never become null and never shift.
    """
    text = F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, length))


@arrow_udf("string")
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and raw Unicode; null stays null."""

    def one(x):
        return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return values.map(one)


def fingerprint(df, *order: str):
    """One row: SHA-256 over the rows' digests in the order of the given key columns.

    Each row is hashed where it lies; the digests, ordered by key, are hashed again in two levels,
    so that no row's text is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    first = F.concat_ws(SEPARATOR, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    rows = df.select(F.substring(F.sha2(first, 256), 1, 3).alias("bucket"), first.alias("k"), row.alias("d"))
    buckets = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("k", F.lit("="), "d"))), "\n"), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


def job_key(kind: str, *parts: Column) -> Column:
    """Names of job folders: ``yt-<id>-<10 hex of the vault>`` and ``kp-<12 hex of the url>``."""
    if kind == "yt":
        return F.concat(F.lit("yt-"), parts[0], F.lit("-"), F.substring(F.sha2(parts[1], 256), 1, 10))
    return F.concat(F.lit("kp-"), F.substring(F.sha2(parts[0], 256), 1, 12))
