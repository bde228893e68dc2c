"""The corpus pipeline: quality rules, near-duplicates, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, packing, quality, simhash
from ledgerlens.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document has a row for each time that words of it are taken, with these words."""
    return mixing.draw(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are packed into sequences; text_hash tells rows of one document with different texts apart."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row"), "text")
    cut = packing.pieces(keyed, *packing.byte_bpe(), id_col="row")
    return packing.pack(written(cut.select("row.doc_id", "row.text_hash", "piece", "start", "length", "ids_crc32"), "pieces"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing_sources", mixing_sources), ("best_fit_packing", best_fit_packing)]

#: The SimHash stage and the tokenizer have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
