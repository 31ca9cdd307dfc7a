"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and reread as the next stage's docs. All but the last return the columns of documents.

1. quality classifier: documents that the scorer rejects go;
2. line dedup: lines of recurring templates go, but for one document of each;
3. near-dedup: one document of each group of near copies (five-word shingles, Jaccard 0.8) stays;
4. mixing: sources are repeated towards the target weights, none is dropped;
5. packing: the mixed documents fill sequences of 4096 tokens in source proportions.

Every stage takes whole texts of any length. A null text counts as empty, and so it does in what line dedup
returns; rows without an id are judged, deduplicated by line, mixed and packed like others, and near-dedup
keeps them; repeated rows are judged alike, and near-dedup keeps all rows of the id that stays; a score equal
to the bound is kept; of equal texts the least id stays. Further columns pass through all stages but the last,
also if their names are those of an operator's own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import line_templates, mixing, near_copies, packing, quality
from factloom.llm.common import Stash, scratch
from factloom.llm.queries import tokenizer_path
from factloom.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.filter_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: A trained scorer and fingerprints have no SQL form; tests compare each stage with its plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table of sf_dir."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes once its result is written
            docs = stash.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
