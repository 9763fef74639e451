"""What the training-data operators share: table access, cutting lineage, word rules, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.scratch import cut, drop_cut, scratch_dir  # noqa: F401

#: Fixed values of the word rule: words are runs of anything but space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once a row even where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def digits_key(text: Column) -> Column:
    """60-bit non-negative ordering key from md5, the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("null"))), 1, 15), 16, 10).cast("long")


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct, out of the way of working columns of the same names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")


def numbered(docs: DataFrame) -> DataFrame:
    """(_doc, _row): whole rows with a number unique to each, written down so that it stays the same when read again."""
    return cut(docs.select(whole(docs), F.monotonically_increasing_id().alias("_row")))
