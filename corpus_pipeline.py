"""From raw documents to packed training sequences: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
Null and empty texts are scored as texts without words and, where kept, pack to their end
id alone; rows without id are documents of their own; of repeated rows with words one
stays.  Other columns pass the first three stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import neardup, packing, quality, toxicity
from tessel.llm.shared import remainder, table, written
from tessel.session import ship

#: The near-duplicate and packing stages are no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that op5's classifier doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 3) != 1)
    return toxicity.kept(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that op10's classifier doesn't call bad."""
    field = quality.train(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0)
    return quality.kept(docs, field)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (null ids last; then by the text's hash, then any).

    Rows are told apart by a number of their own, whatever their ids.  Rows without words are no one's duplicates and stay.
    """
    name = "row"
    while name in docs.columns:
        name = f"_{name}"
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(name).alias("row"))
    found = neardup.near_duplicates(numbered.select(key.alias("key"), "text"), "key").where("kept").select(F.col("key.row").alias(name))
    return numbered.join(found, name, "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("toxicity", clean), ("quality", good), ("near_duplicates", unique), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage returns is written, and read again by the next."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
