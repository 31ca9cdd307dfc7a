"""Markdown folders as sources: discovery, whole texts and front matter."""

from __future__ import annotations

import datetime
import json
import os

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

FRONT = "struct<metadata:string,body:string,body_line:int,problem:string>"


def discover(vault: str, target: str, roots: list[str], skip: str = ".factloom") -> list[str]:
    """Paths of Markdown files below the roots, once each, sorted.

    Roots are absolute and inside the vault; what lies in the target or in a folder named skip
    is no source, and a symbolic link anywhere is refused. The walk reads names only.
    """
    vault, target = os.path.abspath(vault), os.path.abspath(target)
    found: set[str] = set()
    for root in roots:
        if not os.path.isabs(root):
            raise ValueError(f"SOURCE_NOT_ABSOLUTE: {root}")
        if os.path.islink(root):
            raise ValueError(f"UNSAFE_SOURCE: {root}")
        if not os.path.exists(root):
            raise ValueError(f"MISSING_SOURCE: {root}")
        if os.path.commonpath([root, vault]) != vault:
            raise ValueError(f"SOURCE_OUTSIDE_VAULT: {root}")
        if os.path.commonpath([root, target]) == target:
            raise ValueError(f"SOURCE_TARGET_OVERLAP: {root}")
        walk = [(os.path.dirname(root), [], [os.path.basename(root)])] if os.path.isfile(root) else os.walk(root)
        for folder, folders, names in walk:
            for name in [*folders, *names]:
                if os.path.islink(os.path.join(folder, name)):
                    raise ValueError(f"UNSAFE_SOURCE: {os.path.join(folder, name)}")
            folders[:] = [d for d in folders if d != skip and os.path.join(folder, d) != target]
            found |= {os.path.join(folder, n) for n in names if n.lower().endswith(".md")}
    return sorted(found)


def read(spark: SparkSession, paths: list[str] | str, base: str = "") -> DataFrame:
    """(path, markdown, byte_size, content_sha256) of Markdown files, each read once on an executor."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(paths)
    path = F.regexp_replace("path", r"^file:/*", "/")
    if base:
        path = F.when(path.startswith(base.rstrip("/") + "/"), F.substring(path, len(base.rstrip("/")) + 2, 1 << 20)).otherwise(path)
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("markdown"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))


#: libyaml's safe loader where it is there: the same values in a tenth of the time.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


@arrow_udf(FRONT)
def front_matter(texts: pd.Series) -> pd.DataFrame:
    """YAML front matter as JSON text, the body, the line on which it begins, and any problem.

    Without a block the metadata are empty and the body is the text; an unclosed block and one that
    is no mapping are problems.
    """

    def plain(x):
        return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)

    def one(text):
        lines = (text or "").splitlines(keepends=True)
        if not lines or lines[0].strip() != "---":
            return "{}", text or "", 1, None
        for i in range(1, len(lines)):
            if lines[i].strip() == "---":
                break
        else:
            return None, None, None, "unclosed"
        try:
            data = yaml.load("".join(lines[1:i]), _LOADER)
        except yaml.YAMLError:
            return None, None, None, "invalid"
        data = {} if data is None else data
        if not isinstance(data, dict):
            return None, None, None, "not a mapping"
        return json.dumps(data, ensure_ascii=False, default=plain), "".join(lines[i + 1 :]), i + 2, None

    return pd.DataFrame([one(t) for t in texts], columns=["metadata", "body", "body_line", "problem"])


def limits(sources: DataFrame, files: int = 100, each: int = 5_000_000, total: int = 50_000_000) -> DataFrame:
    """Violations of the corpus limits: none may be answered by leaving sources out."""
    sums = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("t"))
    many = sums.select(F.when(F.col("n") > files, "SOURCE_LIMIT_EXCEEDED").when(F.col("n") == 0, "NO_SOURCES").alias("rule_code"), F.lit(None).cast("string").alias("record_id"), F.col("n").cast("string").alias("detail"))
    large = sums.select(F.when(F.col("t") > total, "TOTAL_BYTES_EXCEEDED").alias("rule_code"), F.lit(None).cast("string").alias("record_id"), F.col("t").cast("string").alias("detail"))
    single = sources.where(F.col("byte_size") > each).select(F.lit("SOURCE_BYTES_EXCEEDED").alias("rule_code"), F.col("path").alias("record_id"), F.col("byte_size").cast("string").alias("detail"))
    return many.unionByName(large).where("rule_code IS NOT NULL").unionByName(single)
