"""Limitations next to findings, and dictionaries that are published and read back, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.plans import rules
from sparkloom.plans.catalog import query
from sparkloom.plans.project import ELEMENTS, IMPORTS, STYLES, elements, imports, style_values
from sparkloom.plans.rollups import table
from sparkloom.scratch import scratch_dir
from sparkloom.sources import corpus

UNCLEAR, UNCHECKED, NOTHING = "focus ring removed in an object style: states cannot be told apart", "keyboard access not checked: no patterns", "import.bypass: no wrapped packages to check against"


@query("rule_limitations", f"""
WITH {STYLES}, {ELEMENTS}, {IMPORTS}
SELECT 'a11y.focus.suppressed' AS rule, file, line, 'unsupported-syntax' AS reason, '{UNCLEAR}' AS detail FROM v WHERE property = 'outline' AND value IN ('none', '0 none') AND NOT contains(selector, 'focus') AND source = 'jss'
UNION ALL SELECT 'a11y.pattern.keyboard', file, line, 'spec-unavailable', '{UNCHECKED}' FROM e WHERE role IN ('menu', 'tree', 'slider') AND "kitComponent" IS NULL
UNION ALL SELECT 'import.bypass', '.', NULL, 'no-upstream', '{NOTHING}' UNION ALL SELECT NULL, file, min(line)::INT, 'file-too-large', 'scan' FROM i WHERE line % 100 = 0 GROUP BY file""")
def rule_limitations(spark, sf):
    """What all rules over three fact tables and the scan could not check, without a dictionary of patterns or packages."""
    i = imports(spark, sf)
    scanned = i.where("line % 100 = 0").groupBy("file").agg(F.min("line").alias("line")).select("file", "line", F.lit("file-too-large").alias("reason"), F.lit("scan").alias("detail"))
    return rules.check(rules.Tables(style_values=style_values(spark, sf), elements=elements(spark, sf), imports=i), scanned=scanned)[1]


SCHEMAS = {"tokens": "id bigint, name string, px double", "owners": "name string, sizes array<int>"}


@query("corpus_published", """
SELECT 'whole' AS kit, 'updated' AS origin, '2' AS version, p_partkey AS id, p_name AS name, p_retailprice AS px, p_size AS more FROM part
UNION ALL SELECT 'broken', 'embedded', '0', p_partkey, 'own', NULL, NULL FROM part WHERE p_size = 1 UNION ALL SELECT 'none', 'embedded', '0', p_partkey, 'own', NULL, NULL FROM part WHERE p_size = 1""")
def corpus_published(spark, sf):
    """Three dictionaries: one published twice, one whose second member is bad and falls back whole, one never published."""
    part = table(spark, sf, "part")
    root = f"{scratch_dir(spark)}/kits-{uuid.uuid4().hex}"
    tokens = part.select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("double").alias("px"), F.col("p_size").cast("bigint").alias("more"))
    owners = part.groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set(F.col("p_size").cast("int"))).alias("sizes"))
    own = {"tokens": part.where("p_size = 1").select(F.col("p_partkey").cast("bigint").alias("id"), F.lit("own").alias("name"), F.lit(None).cast("double").alias("px"), F.lit(None).cast("bigint").alias("more")), "owners": owners}
    corpus.write_corpus(spark, root, "whole", {"tokens": tokens.limit(0), "owners": owners}, "1", None, "2024-01-01")
    corpus.write_corpus(spark, root, "whole", {"tokens": tokens, "owners": owners}, "2", None, "2024-01-02")
    corpus.write_corpus(spark, root, "broken", {"tokens": tokens, "owners": owners.select("name", F.lit("no list").alias("sizes"))}, "3", None, "2024-01-03")
    out = None
    for kit in ("whole", "broken", "none"):
        got = corpus.read_corpus(spark, root, kit, SCHEMAS, {"tokens": ["id"], "owners": ["name"]}, own, "0")
        rows = got.members["tokens"].select(F.lit(kit).alias("kit"), F.lit(got.provenance["kind"]).alias("origin"), F.lit(got.provenance["version"]).alias("version"), "id", "name", "px", "more")
        out = rows if out is None else out.unionByName(rows)
    return out
