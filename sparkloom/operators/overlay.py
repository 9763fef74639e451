"""Rule configuration over findings: level lookup with fallbacks, overlay, tally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import longest_prefix_join


def resolve_level(findings: DataFrame, config: DataFrame, default: str = "on") -> DataFrame:
    """level of each finding: exact rule/subkind, then the longest dotted prefix of the rule, the category, the default."""
    exact = config.select(F.col("key").alias("_exact"), F.col("level").alias("_a"))
    category = config.select(F.col("key").alias("_category"), F.col("level").alias("_c"))
    rows = findings.withColumn("_exact", F.concat_ws("/", "rule", "subkind")).join(exact, "_exact", "left").join(
        category, F.concat(F.lit("category:"), F.col("category")) == F.col("_category"), "left")
    rows = longest_prefix_join(rows, "rule", config.select(F.col("key").alias("_rule"), F.col("level").alias("_b")), "_rule", "_b")
    return rows.withColumn("level", F.coalesce("_a", "_b", "_c", F.lit(default))).drop("_exact", "_category", "_a", "_b", "_c")


def apply_config(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Drops findings whose level is off, keeps severities where it is on, else overrides them."""
    levelled = resolve_level(findings, config).where("level <> 'off'")
    return levelled.withColumn("severity", F.when(F.col("level") == "on", F.col("severity")).otherwise(F.col("level"))).drop("level")


def tally(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Visible and hidden counts in total, by category and by rule, in one shuffle."""
    levelled = resolve_level(findings, config).withColumn("visible", F.col("level") != "off")
    return levelled.groupingSets([[], [F.col("category")], [F.col("rule")]], "category", "rule").agg(
        F.count_if("visible").alias("visible"), F.count_if(~F.col("visible")).alias("hidden"))
