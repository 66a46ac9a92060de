"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last give the columns of documents.

Cases, in every stage: null and empty texts fail the base rule and go in the first, elsewhere they stay; long texts are
read whole; repeated rows become one in the second; an empty table gives an empty one; other columns, whatever their
names, are carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import Tables, documents
from waymark.llm.mixing import mix
from waymark.llm.near_duplicates import one_of_each
from waymark.llm.packing import pack
from waymark.llm.quality_rules import keep_good
from waymark.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules or the base rule reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; a text goes only where a linked one stays."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the scan finds in it is replaced."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come again, up to twice, so that sources near their target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]

#: Learned rules, sketches, guess costs and token ids have no form in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs, held = Tables(spark, "pipeline"), documents(spark, sf_dir), None
    for _, stage in STAGES:
        new = tables.put(stage(spark, docs, sf_dir))
        if held is not None:
            tables.drop(held)
        docs = held = new
    return docs
