"""A drop folder of Markdown notes as a stream: each micro-batch updates a published source table.

This is the library's own addition. Files arrive as a stream of whole texts; every batch is merged
with the published sources by the incremental operators, so that the table after any sequence of
batches equals a build from all files at once. Batches are applied once each: the pointer file names
the last batch that is in the table, and a batch that is replayed after a failure is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import incremental
from factloom.sources.markdown import front_matter
from factloom.sources.records import Publication

FILES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])
SOURCES = "path string, source_url string, title string, content_sha256 string, byte_size long, modified timestamp, source_id string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, markdown, modified) of notes as they arrive; a note that is written anew arrives again."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    base = folder.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/*", "/")
    short = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)
    return raw.select(short.alias("path"), F.decode("content", "UTF-8").alias("markdown"), F.col("modificationTime").alias("modified"))


def sources_of(notes: DataFrame) -> DataFrame:
    """Source rows without ids; of a path that comes twice in a batch the latest counts."""
    parsed = incremental.latest(notes, "path", "modified").withColumn("f", front_matter("markdown"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    return parsed.where("f.problem IS NULL").select(
        "path", F.nullif(F.get_json_object("f.metadata", "$.source_url"), F.lit("")).alias("source_url"), F.coalesce(F.get_json_object("f.metadata", "$.title"), stem).alias("title"),
        F.sha2("markdown", 256).alias("content_sha256"), F.octet_length("markdown").cast("long").alias("byte_size"), "modified",
    )


def apply_batch(publication: Publication, batch: DataFrame, batch_id: int) -> None:
    """Merge one micro-batch into the published sources."""
    state = publication.current()
    if state is not None and int(state["fingerprint"]) >= batch_id:
        return
    new = sources_of(batch)
    if state is None:
        before = batch.sparkSession.createDataFrame([], SOURCES)
    else:
        before = publication.read("sources")
    named = incremental.carried_ids(new, before).select(*before.columns)
    kept = before.join(new.select("path"), "path", "left_anti").select(*before.columns)
    publication.publish({"sources": kept.unionByName(named)}, str(batch_id))


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = False):
    """Start the stream; once processes what is there and stops."""
    publication = Publication(spark, target)
    writer = read(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(publication, df, i))
    return (writer.trigger(availableNow=True) if once else writer).start()
