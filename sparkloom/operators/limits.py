"""What was not checked: limitation rows of rules and scans, their union and order; lists and their orders in reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.numbers import severity_rank

#: The reasons of checks that were not made.
NOT_CHECKED = ["spec-unavailable", "unsupported-syntax"]


def limitation(rows: DataFrame, reason: str, detail: str) -> DataFrame:
    return rows.select("file", F.col("line").cast("int").alias("line"), F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))


def project_limitation(once: DataFrame, reason: str, detail: str) -> DataFrame:
    """One limitation of the whole project for each row of ``once``: at ``.``, without a line."""
    return once.select(F.lit(".").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))


def focus_limitations(style_values: DataFrame, flattened: list[str]) -> DataFrame:
    """Focus rings taken away in object styles, where states cannot be told apart."""
    value = F.lower(F.trim("value"))
    none = F.col("property").isin("outline", "outline-style") & F.array_contains(F.split(value, r"\s+"), "none")
    off = none | (F.col("property").isin("outline", "outline-style", "outline-width") & value.isin("none", "0", "0px"))
    unclear = style_values.where(off & ~F.col("dynamic") & ~F.coalesce(F.lower("selector").contains("focus"), F.lit(False)) & F.col("source").isin(flattened))
    return limitation(unclear, "unsupported-syntax", "focus ring removed in an object style: states cannot be told apart")


def keyboard_limitations(elements: DataFrame, roles: list[str], patterns: DataFrame | None) -> DataFrame:
    """Widgets that could not be checked because no dictionary of patterns is there."""
    widgets = elements.where(F.col("props")["role"].isin(roles) & F.col("kitComponent").isNull())
    return limitation(widgets if patterns is None else widgets.limit(0), "spec-unavailable", "keyboard access not checked: no patterns")


def all_limitations(*parts: DataFrame) -> DataFrame:
    """One bag of limitations, by file, then line (none as 0), reason and detail."""
    return reduce(DataFrame.unionByName, parts).orderBy("file", F.coalesce("line", F.lit(0)), "reason", "detail")


def not_checked(limitations: DataFrame) -> DataFrame:
    return limitations.where(F.col("reason").isin(NOT_CHECKED))


def order_lint(messages: DataFrame) -> DataFrame:
    return messages.orderBy("file", "line", "column", "rule", "ord")


def flat_order(findings: DataFrame) -> DataFrame:
    """Worst severity first, then the most occurrences, then the place."""
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("occurrences"), "file", "line", "ord")


def new_only(findings: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Findings whose key an earlier run did not have."""
    return findings.join(known.select(*key).distinct(), key, "left_anti")


def replace_rules(generic: DataFrame, own: DataFrame, replaced: DataFrame) -> DataFrame:
    """A registry with replacement: generic rows without the replaced ids, then an adapter's own."""
    return generic.join(replaced.select("id"), "id", "left_anti").unionByName(own)
