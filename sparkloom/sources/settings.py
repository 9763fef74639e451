"""Rule settings: merged, checked and loaded; the catalog of rules; documents with stable keys; a page around a payload."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of a rule, the file that holds them, categories in report order.
LEVELS = ["off", "on", "error", "warning", "info", "candidate", "inherit"]
FILE = "rules.config.json"
CATEGORIES = ["a11y", "icon", "component", "token", "typography", "font", "api", "override"]


def merged(base: Column, over: Column) -> Column:
    """Two maps as one, key by key; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def parse_overrides(packed: Column) -> Column:
    """map<key, level> of ``key:level;...``; entries without a known level are dropped."""
    return F.map_filter(F.str_to_map(packed, F.lit(";"), F.lit(":")), lambda k, v: (k != "") & v.isin(LEVELS))


def pack_overrides(levels: Column) -> Column:
    """``key:level;...`` of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(levels)), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")


def stable_json(value, indent: int = 2) -> str:
    """JSON with sorted keys on every level and a last line end."""
    return json.dumps(value, indent=indent, sort_keys=True, ensure_ascii=False) + "\n"


def parse_settings(source: str) -> dict[str, str]:
    """Levels by key; unknown keys of the document and unknown levels are errors, ``inherit`` is no opinion."""
    found = json.loads(source)
    if not isinstance(found, dict) or set(found) - {"rules", "$schema"} or not isinstance(found.get("rules", {}), dict):
        raise ValueError("settings hold rules and nothing else")
    bad = sorted(k for k, v in found.get("rules", {}).items() if v not in LEVELS)
    if bad:
        raise ValueError(f"unknown level of {', '.join(bad)}")
    return {k: v for k, v in found.get("rules", {}).items() if v != "inherit"}


def load_settings(explicit: str | None = None, project: str | None = None, here: str = ".") -> tuple[dict[str, str], str | None]:
    """(levels, path): a named file must be there; else the project's, else the one here, else none."""
    paths = [os.path.join(here, explicit)] if explicit else [os.path.join(d, FILE) for d in (project, here) if d]
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                return parse_settings(file.read()), path
        if explicit:
            raise FileNotFoundError(path)
    return {}, None


def catalog_rows(spark: SparkSession, registry: dict) -> DataFrame:
    """id and category of every rule, by category in report order, then id."""
    rows = sorted(((r.id, r.category) for r in registry.values()), key=lambda x: (CATEGORIES.index(x[1]) if x[1] in CATEGORIES else len(CATEGORIES), x[0]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, id string, category string")


def settings_template(registry: dict) -> str:
    """A settings document that names every rule and changes none."""
    return stable_json({"rules": dict.fromkeys(sorted(registry), "inherit")})


def settings_schema(registry: dict) -> str:
    """The JSON schema of settings documents."""
    return stable_json({"type": "object", "additionalProperties": False, "properties": {"$schema": {"type": "string"}, "rules": {"type": "object", "additionalProperties": False, "properties": {
        k: {"enum": LEVELS} for k in sorted({*registry, *(r.category for r in registry.values())})}}}})


def payload(findings: DataFrame) -> DataFrame:
    """Findings with defaults for what they lack, and counts of every category, zero ones included, as one JSON document a row."""
    spark = findings.sparkSession
    known = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "ord int, category string")
    counts = known.join(findings.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).alias("n"))
    by_category = counts.agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("ord", "category", "n"))), lambda x: F.struct(x["category"], x["n"]))).alias("categories"))
    full = findings.select("id", "rule", F.coalesce("subkind", F.lit("")).alias("subkind"), "category", "severity", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "file", "line", "column", "actual", F.coalesce("expected", F.lit("")).alias("expected"), "impactKey")
    return full.select(F.lit("finding").alias("kind"), F.to_json(F.struct("*")).alias("document")).unionByName(by_category.select(F.lit("categories").alias("kind"), F.to_json("categories").alias("document")))


def page(title: str, document: str) -> str:
    """A page that holds a JSON document; what could end the script early is escaped."""
    safe = document.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    head = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{head}</title></head><body><script type="application/json" id="payload">{safe}</script></body></html>'


@dataclass
class Adapter:
    """A dictionary as a plug-in: its packages, tables, own rules, the generic ones it replaces, and scalars for the summary."""

    id: str
    packages: list[str]
    tables: Callable[[SparkSession], dict[str, DataFrame]]
    rules: list[str] = field(default_factory=list)
    replaces: list[str] = field(default_factory=list)
    extras: Callable[[DataFrame], dict[str, float]] | None = None


def active_rules(registry: dict, adapter: Adapter | None) -> list[str]:
    """Ids of the rules that run: without an adapter those it does not own, with one its own in place of the replaced."""
    if adapter is None:
        return sorted(registry)
    return sorted((set(registry) - set(adapter.replaces)) | set(adapter.rules))


def select_adapter(adapters: list[Adapter], dependencies: set[str], imports: DataFrame) -> Adapter | None:
    """The adapter whose packages a project declares; of several, the one imported most, then declared most, then by name."""
    declared = [(a, sum(p in dependencies for p in a.packages)) for a in adapters]
    able = [(a, n) for a, n in declared if n]
    if len(able) < 2:
        return able[0][0] if able else None
    counts = {a.id: F.count_if(F.coalesce(F.col("package").isin(a.packages), F.lit(False))).alias(a.id) for a, _ in able}
    row = imports.agg(*counts.values()).first()  # one number an adapter
    return min(able, key=lambda x: (-row[x[0].id], -x[1], x[0].id))[0]
