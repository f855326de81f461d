"""From raw documents to packed training sequences: five stages, each on what the last kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and hands the
written rows on. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import decontamination, lines, packing, quality, simhash, wordsets
from matchlens.llm.store import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; rejected ones go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier one has; ``n_chars`` follows the text."""
    left = lines.dedup_lines(docs)
    if "n_chars" in left.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.char_length("text").cast(kind))
    return left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id: linked by
    fingerprints as in op6, or by four fifths of their runs of five words."""
    return simhash.one_of_each(docs, wordsets.similar)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (at least one word in twenty)."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their place in a sequence of at most 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Hashed features, XXH64 fingerprints and token ids have no SQL; tests check the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
