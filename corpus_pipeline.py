"""The corpus pipeline: five stages over documents, each calling one operator of sparkloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. The mixing stage's rows stand in training order in their files, and sequences follow that order.

Defined results: null, empty and blank texts fail the quality rules; repeated rows are rows of their own there, one
occurrence in line dedup, and copies of which one stays in near-dedup; a text that loses all its lines stays, empty, and
takes no part in the mix; ties are broken by doc_id, null last; a null lang or source is a group of its own; very long
texts are read whole; an empty table passes through all stages and gives no sequence; further columns are carried along
up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup, mixing, packing, quality, simhash, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; n_chars follows."""
    return line_dedup.dedup(docs, counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Links: SimHash fingerprints of five-word shingles that differ in at
    most three bits and, as fingerprints see no more than near equality, a Jaccard similarity of 0.8 or more; groups are
    reached over links of both kinds, so that a document dropped for one kind still links its others."""
    return similar.drop_near_duplicates(docs, also=simhash.roots)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Outlier estimates, fingerprints and tokens are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
