"""JSON records: strict reading against a declared schema, canonical writing, build manifests.

Strict means that unknown or missing fields and values of another type are violations; nothing is
coerced. Types are checked on the parsed variant of each field.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources import files

_KINDS = {
    T.StringType: "STRING", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.BooleanType: "BOOLEAN",
}


def _type_fits(variant: Column, path: str, kind: T.DataType) -> Column:
    found = F.schema_of_variant(F.variant_get(variant, path, "variant"))
    if isinstance(kind, T.ArrayType):
        return found.startswith("ARRAY<")
    if isinstance(kind, (T.StructType, T.MapType)):
        return found.startswith("OBJECT<")
    if isinstance(kind, T.DoubleType):
        return found.rlike(r"^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$")
    return found == _KINDS[type(kind)]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text files, of which each may be many splits.

    Spark splits a file by ranges of bytes, and a split's lines come in the order of the file. A line's
    number is its place within its split, which rising row ids give, plus the lines of the file's earlier splits, a
    running sum over one row a split. Only line feeds end lines; a line is in the split in which it begins.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    raw = spark.read.option("lineSep", "\n").text(path).select(*split, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("file", "at", (earlier - F.col("first")).alias("shift"))
    return raw.join(begins, ["file", "at"]).select("file", (F.col("id") + F.col("shift") + 1).alias("line_number"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of JSON Lines files. Blank lines are skipped.

    A violation has the line's number in its file and the first reason: invalid JSON, unknown fields, a missing
    required field, or a value of another type. A large file is read by many tasks.
    """
    lines = numbered_lines(spark, path).where(F.trim("line") != "").select("line_number", "line", F.try_parse_json("line").alias("v"))
    names = F.array(*(F.lit(f.name) for f in schema))
    unknown = F.array_except(F.json_object_keys("line"), names)
    reason = F.when(F.col("v").isNull(), "invalid JSON").when(F.json_object_keys("line").isNull(), "not an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), unknown[0]))
    for f in schema:
        there = F.array_contains(F.json_object_keys("line"), f.name)
        value = F.variant_get("v", f"$.{f.name}", "variant")
        null = ~there | F.is_variant_null(value)
        if not f.nullable:
            reason = reason.when(null, f"missing field {f.name}")
        reason = reason.when(~null & ~_type_fits(F.col("v"), f"$.{f.name}", f.dataType), f"type of {f.name}")
    judged = lines.withColumn("detail", reason)
    bad = judged.where("detail IS NOT NULL").select(F.lit("INVALID_IR").alias("rule_code"), F.col("line_number").cast("string").alias("record_id"), "detail")
    good = judged.where("detail IS NULL").select(F.from_json("line", schema).alias("r")).select("r.*")
    return good, bad


def write_jsonl(df: DataFrame, path: str, *key: str) -> None:
    """Canonical JSON Lines: keys in order, raw Unicode, rows sorted by key; committed by Spark."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(*key).select(text.alias("value")).write.mode("errorifexists").text(path)


def write_json_atomic(path: str, value) -> None:
    """A control file on the driver: written beside, synced, renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def tree_hash(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below root, relative to it; root may lie in any file system."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = files.qualified(spark, root).rstrip("/") + "/"
    return raw.select(F.substring("path", len(base) + 1, 1 << 20).alias("path"), F.sha2("content", 256).alias("sha256"))


def new_build_id() -> str:
    return f"{int(time.time())}-{uuid.uuid4().hex[:8]}"


def manifest_digest(state: dict) -> str:
    """Digest of what a pointer says about its build: all but the digest itself."""
    rest = {k: v for k, v in state.items() if k != "manifest_sha256"}
    return hashlib.sha256(json.dumps(rest, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Publication:
    """Builds of a knowledge base: tables below builds/<id>, and a pointer file that names the current one.

    Tables are written first and verified as written; then one rename of the pointer publishes them.
    Until it, readers see the previous build; a failure removes what was written. A lease keeps two
    publishers apart: one that dies is taken over after ``lease_seconds`` without a sign of life, which a publisher gives
    before each table, and one that was taken over publishes no more. The target may lie in any file system
    that Spark reaches.
    """

    def __init__(self, spark: SparkSession, target: str, lease_seconds: float = 3600.0):
        self.spark, self.target, self.lease_seconds = spark, target, lease_seconds

    def current(self) -> dict | None:
        found = files.read_text(self.spark, f"{self.target}/current.json")
        return None if found is None else json.loads(found)

    def read(self, table: str) -> DataFrame:
        state = self.current()
        if state is None or table not in state["tables"]:
            raise ValueError(f"VERIFY_MANIFEST: {table}")
        return self.spark.read.parquet(f"{self.target}/builds/{state['build_id']}/{table}")

    def publish(self, tables: dict[str, DataFrame], fingerprint: str, verify=None, build_id: str | None = None) -> dict:
        """Publish tables; equal fingerprints publish nothing. verify(read) raises to refuse."""
        state = self.current()
        if state is not None and state["fingerprint"] == fingerprint:
            return {**state, "status": "noop"}
        lease = files.Lease(self.spark, f"{self.target}/publish.lock", self.lease_seconds)
        if not lease.take():
            raise ValueError("PUBLISH_LOCKED")
        build = build_id or new_build_id()
        root = f"{self.target}/builds/{build}"
        try:
            for name, df in tables.items():
                lease.beat()
                df.write.parquet(f"{root}/{name}")
            lease.beat()
            if verify is not None:
                verify(lambda name: self.spark.read.parquet(f"{root}/{name}"))
            written = {r.path: r.sha256 for r in tree_hash(self.spark, root).where("path NOT LIKE '%.crc'").collect()}
            new = {"build_id": build, "fingerprint": fingerprint, "tables": sorted(tables), "files": written, "previous": state and state["build_id"]}
            new["manifest_sha256"] = manifest_digest(new)
            lease.beat()
            files.write_text(self.spark, f"{self.target}/current.json", json.dumps(new, ensure_ascii=False, sort_keys=True, indent=2))
            return {**new, "status": "published"}
        except BaseException:
            files.delete(self.spark, root)
            raise
        finally:
            lease.release()

    def drifted(self) -> DataFrame:
        """Files of the current build that are not as they were published."""
        from factloom.operators.incremental import drift

        state = self.current()
        recorded = self.spark.createDataFrame(list(state["files"].items()), "path string, sha256 string")
        return drift(recorded, tree_hash(self.spark, f"{self.target}/builds/{state['build_id']}").where("path NOT LIKE '%.crc'"))
