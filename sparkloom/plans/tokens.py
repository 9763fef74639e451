"""Tokens of themes whose trees are made from parts: extraction, counts, scales, look-up and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import tokens
from sparkloom.plans.catalog import query
from sparkloom.plans.rollups import table
from sparkloom.scratch import spread

KIT, COLOUR = "concat('k', p_partkey % 20)", "lpad(lower(hex(p_partkey * 7919 % 16777216)), 6, '0')"
#: One tree a part, tier and mode: (tier, mode, condition, value under its path).
TREES = [
    ("ref", "CAST(NULL AS STRING)", "true", f"""concat('{{"palette":{{"', p_type, '":{{"c', p_partkey, '":"#', {COLOUR}, '"}}}},"fontSize":{{"s', p_partkey, '":', p_size, '}}}}')"""),
    ("ref", "CAST(NULL AS STRING)", "p_partkey % 50 = 0", """concat('{"bg":{"b', p_partkey, '":"1px"}}')"""),
    ("sys", "'light'", "true", """concat('{"bg":{"b', p_partkey, '":"{edsRef.palette.', p_type, '.c', p_partkey, '}"}}')"""),
    ("sys", "'dark'", "p_partkey % 3 = 0", """concat('{"bg":{"b', p_partkey, '":"rgba({edsRef.palette.', p_type, '.c', p_partkey, '},0.5)"}}')"""),
    ("sys", "'dark'", "p_partkey % 3 = 1", """concat('{"bg":{"b', p_partkey, '":"{edsRef.palette.none}"}}')"""),
    ("comp", "CAST(NULL AS STRING)", "true", """concat('{"b', p_size % 3, '":{"bodyColorBackgroundPrimary', p_partkey, 'Hover":"', CASE WHEN p_partkey % 5 = 0 THEN '4px' ELSE concat('{edsSys.bg.b', p_partkey, '}') END, '"}}')""")]

#: The tokens that must come out, and what they resolve to.
TOKENS = """
p AS (SELECT p_partkey AS k, 'k' || p_partkey % 20 AS kit, p_type AS t, p_size AS s, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS h FROM part),
s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'rgba(' || h || ',0.5)' WHEN 1 THEN '{edsRef.palette.none}' ELSE h END AS dark, CASE k % 3 WHEN 0 THEN substr(h, 2) || '80' WHEN 2 THEN substr(h, 2) || 'ff' END AS shade FROM p),
tok AS (
 SELECT kit, 'ref' AS tier, 'ref.palette.' || t || '.c' || k AS id, 'color' AS kind, 'color' AS category, h AS light, h AS dark, substr(h, 2) || 'ff' AS color_light, substr(h, 2) || 'ff' AS color_dark, NULL::DOUBLE AS px, '--sds-palette-' || t || '-c' || k AS variable, NULL::VARCHAR AS component, NULL::VARCHAR AS facets, 0 AS refs FROM s
 UNION ALL SELECT kit, 'ref', 'ref.fontSize.s' || k, 'fontSize', 'typography', s::VARCHAR, s::VARCHAR, NULL, NULL, s::DOUBLE, '--sds-fontSize-s' || k, NULL, NULL, 0 FROM s
 UNION ALL SELECT kit, 'ref', 'ref.bg.b' || k, 'dimension', 'dimension', '1px', '1px', NULL, NULL, 1.0, '--sds-bg-b' || k, NULL, NULL, 0 FROM s WHERE k % 50 = 0
 UNION ALL SELECT kit, 'sys', 'sys.bg.b' || k, 'color', 'color', h, dark, substr(h, 2) || 'ff', shade, NULL, '--sds-bg-b' || k, NULL, NULL, 1 FROM s
 UNION ALL SELECT kit, 'comp', 'comp.b' || s % 3 || '.bodyColorBackgroundPrimary' || k || 'Hover', 'color', 'color', CASE WHEN k % 5 = 0 THEN '4px' ELSE h END, CASE WHEN k % 5 = 0 THEN '4px' ELSE dark END,
   CASE WHEN k % 5 > 0 THEN substr(h, 2) || 'ff' END, CASE WHEN k % 5 > 0 THEN shade END, CASE WHEN k % 5 = 0 THEN 4.0 END, NULL, 'b' || s % 3, 'body|color|background,primary,' || k || '|hover|primary', CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END FROM s)"""


def trees(spark: SparkSession, sf: str) -> DataFrame:
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), "p_partkey")
    made = F.array_compact(F.array(*(F.expr(f"CASE WHEN {test} THEN named_struct('tier', '{tier}', 'mode', {mode}, 'tree', {tree}) END") for tier, mode, test, tree in TREES)))
    return parts.select(F.expr(KIT).alias("kit"), F.col("p_partkey").cast("string").alias("file"), F.explode(made).alias("t")).select("kit", "t.tier", "t.mode", "file", "t.tree")


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.extract_tokens(trees(spark, sf), "sds")


@query("tokens_extracted", f"WITH {TOKENS} SELECT kit, id, tier, kind, category, light, dark, color_light, color_dark, px, variable, component, facets, refs, light <> dark AS theme_dependent FROM tok")
def tokens_extracted(spark, sf):
    f = F.col("facets")
    packed = F.concat_ws("|", f["slot"], f["category"], F.array_join(f["modifiers"], ","), f["state"], f["view"])
    return extracted(spark, sf).select(
        "kit", "id", "tier", "kind", "category", F.col("resolved.light").alias("light"), F.col("resolved.dark").alias("dark"), F.col("color.light").alias("color_light"), F.col("color.dark").alias("color_dark"),
        F.col("px.light").alias("px"), F.col("cssVariable").alias("variable"), "component", F.when(f.isNotNull(), packed).alias("facets"), F.size("references.light").alias("refs"), F.col("themeDependent").alias("theme_dependent"))


@query("token_counts", f"""
WITH {TOKENS} SELECT kit, 'total' AS facet, '' AS value, count(*) AS n FROM tok GROUP BY kit UNION ALL SELECT kit, 'tier', tier, count(*) FROM tok GROUP BY kit, tier UNION ALL SELECT kit, 'category', category, count(*) FROM tok GROUP BY kit, category
UNION ALL SELECT kit, 'kind', kind, count(*) FROM tok GROUP BY kit, kind UNION ALL SELECT kit, 'cssVariables', '', count(variable) FROM tok GROUP BY kit UNION ALL SELECT kit, 'themeDependent', '', count(*) FROM tok WHERE light <> dark GROUP BY kit
UNION ALL SELECT kit, 'components', '', count(DISTINCT component) FROM tok GROUP BY kit""")
def token_counts(spark, sf):
    return tokens.token_counts(extracted(spark, sf))


@query("token_scales", f"""
WITH {TOKENS} SELECT DISTINCT kit, 'fontSizePx' AS scale, light AS step, px AS number FROM tok WHERE kind = 'fontSize' UNION ALL SELECT DISTINCT kit, 'allDimensionPx', px::BIGINT::VARCHAR, px FROM tok WHERE px IS NOT NULL""")
def token_scales(spark, sf):
    return tokens.token_scales(extracted(spark, sf))


@query("token_lookup", f"""
WITH {TOKENS} SELECT kit, 'color' AS index, 'light' AS mode, color_light AS key, id FROM tok WHERE color_light IS NOT NULL UNION ALL SELECT kit, 'color', 'dark', color_dark, id FROM tok WHERE color_dark IS NOT NULL
UNION ALL SELECT kit, 'dimensionPx', unnest(['light', 'dark']), px::BIGINT::VARCHAR, id FROM tok WHERE px IS NOT NULL UNION ALL SELECT kit, 'literal', 'light', light, id FROM tok UNION ALL SELECT kit, 'literal', 'dark', dark, id FROM tok
UNION ALL SELECT kit, 'cssVariable', NULL, variable, min(id) FROM tok WHERE variable IS NOT NULL GROUP BY kit, variable""")
def token_lookup(spark, sf):
    return tokens.token_lookup(extracted(spark, sf))


@query("token_diagnostics", f"""
WITH {TOKENS}, f AS (
 SELECT DISTINCT kit, 'spacing-scale-missing' AS code, 'warning' AS severity, string_split(id, '.')[2] AS sample FROM tok WHERE tier = 'ref'
 UNION ALL SELECT kit, 'reference-unresolved', 'error', id FROM tok WHERE dark LIKE '{{%' UNION ALL SELECT kit, 'comp-token-literal', 'warning', id FROM tok WHERE tier = 'comp' AND refs = 0
 UNION ALL SELECT kit, 'sys-color-theme-invariant', 'info', id FROM tok WHERE tier = 'sys' AND light = dark
 UNION ALL SELECT kit, 'css-variable-collision', 'error', variable || ' <- ' || min(id) || ', ' || max(id) FROM tok WHERE variable IS NOT NULL GROUP BY kit, variable HAVING count(*) > 1)
SELECT kit, code, severity, count(*) AS "count", array_to_string(list_sort(list(sample))[1:10], ';') AS samples FROM f GROUP BY ALL""")
def token_diagnostics(spark, sf):
    found = tokens.token_diagnostics(tokens.cut(extracted(spark, sf)))
    return found.withColumn("samples", F.array_join("samples", ";"))
