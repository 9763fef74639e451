"""Literals, class links, variables and re-export closures over facts that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import values
from sparkloom.operators import classes, graph, kit
from sparkloom.plans import rules
from sparkloom.plans.catalog import query
from sparkloom.plans.rollups import table
from sparkloom.scratch import spread
from sparkloom.sources import scss

LITERALS = ("CAST(p_size AS STRING) || 'px /* 9px */ #' || substr(md5(p_name), 1, 6) || ' var(--c' || CAST(p_size % 10 AS STRING) || ', #fff) url(#abc) RGB(1, min(2, (' || CAST(p_size AS STRING) || ')), 3) gold-x '"
            " || CASE p_partkey % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'none' ELSE 'rgb(1, -2.5rem' END")


@query("value_literals", f"""
WITH v AS (SELECT p_partkey, p_size, p_name, {LITERALS} AS value FROM part),
f AS (SELECT p_partkey, value, unnest([
  {{'kind': 'dimension', 'raw': p_size || 'px', 'find': p_size || 'px'}}, {{'kind': 'color', 'raw': '#' || substr(md5(p_name), 1, 6), 'find': '#' || substr(md5(p_name), 1, 6)}},
  {{'kind': 'var', 'raw': '--c' || p_size % 10, 'find': 'var('}}, {{'kind': 'color', 'raw': 'RGB(1, min(2, (' || p_size || ')), 3)', 'find': 'RGB('}},
  {{'kind': CASE p_partkey % 3 WHEN 0 THEN 'color' WHEN 2 THEN 'dimension' END, 'raw': CASE p_partkey % 3 WHEN 0 THEN 'Gold' ELSE '-2.5rem' END, 'find': CASE p_partkey % 3 WHEN 0 THEN 'Gold' ELSE '-2.5rem' END}}], recursive := true) FROM v)
SELECT p_partkey, kind, raw, (strpos(value, find) - 1)::INTEGER AS "offset" FROM f WHERE kind IS NOT NULL""")
def value_literals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{LITERALS} AS value")
    return values.value_literals(rows).drop("value")


COLOR = {
    "file": "'f' || CAST(p_partkey % 40 AS STRING) || '.css'", "line": "CAST(p_partkey AS INT)", "ord": "CAST(p_partkey AS INT)", "source": "CASE p_partkey % 9 WHEN 0 THEN 'ts-literal' WHEN 1 THEN 'inline-style' ELSE 'css' END",
    "property": "CASE p_size % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'background' ELSE 'box-shadow' END",
    "value": "'1px ' || CASE p_partkey % 7 WHEN 0 THEN '#F00' WHEN 1 THEN 'rgb(255, 0, 0)' WHEN 2 THEN '#fe0000' WHEN 3 THEN '#e00000' WHEN 4 THEN '#00ff00' WHEN 5 THEN '#ff000080' ELSE 'black url(#f00)' END"}
COLOR_FACTS = ", ".join(f'{x} AS "{c}"' for c, x in COLOR.items())


@query("rule_literal_color", f"""
WITH v AS (SELECT p_partkey, {COLOR_FACTS} FROM part),
k AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN '#F00' WHEN 1 THEN 'rgb(255, 0, 0)' WHEN 2 THEN '#fe0000' WHEN 3 THEN '#e00000' WHEN 4 THEN '#00ff00' WHEN 5 THEN '#ff000080' ELSE 'black' END AS lit,
             CASE WHEN p_partkey % 7 IN (0, 1, 6) THEN 'exact' WHEN p_partkey % 7 = 2 THEN 'near' WHEN p_partkey % 7 = 3 THEN 'shade' ELSE 'foreign' END AS subkind,
             CASE WHEN source = 'ts-literal' OR property = 'box-shadow' THEN '' ELSE property END AS role FROM v WHERE NOT (source = 'ts-literal' AND p_partkey % 7 = 6))
SELECT 'token.literal.color' AS rule, subkind, CASE subkind WHEN 'exact' THEN 'error' WHEN 'shade' THEN 'info' ELSE 'warning' END AS severity,
       CASE WHEN subkind = 'exact' AND role = '' AND lit <> 'black' THEN 0.7 WHEN subkind = 'exact' THEN 1.0 WHEN subkind = 'foreign' THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, file, line,
       (5 + CASE WHEN source = 'css' THEN length(property) + 2 ELSE 0 END)::INTEGER AS "column", lit AS actual,
       CASE WHEN lit = 'black' THEN 'ink' WHEN subkind = 'foreign' THEN NULL WHEN role = 'color' THEN 'text' ELSE 'back' END AS expected, 'token.literal.color:' || lower(lit) AS "impactKey" FROM k""")
def rule_literal_color(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(*(f"{x} AS `{c}`" for c, x in COLOR.items())).withColumn("column", F.lit(1))
    tokens = spark.createDataFrame([("back", "#ff0000", "semantic", "background"), ("text", "#f00", "semantic", "foreground"), ("pure", "#ff0000ff", "primitive", None), ("ink", "#000", "primitive", None)], "id string, hex string, tier string, role string")
    found = rules.literal_color(rules.Tables(style_values=rows, tokens=tokens))
    return found.select("rule", "subkind", "severity", "confidence", "file", "line", "column", "actual", "expected", "impactKey")


CLASSES = "CASE WHEN p_partkey % 7 = 0 THEN array() ELSE array('k' || CAST(p_partkey % 101 AS STRING), 'k' || CAST(p_size * 3 AS STRING), 'k0') END"
REFS = {
    "module": "'f' || CAST(c_custkey % 40 AS STRING) || '.css'", "className": "'k' || CAST(c_custkey % 97 AS STRING)", "file": "'e' || CAST(c_custkey % 30 AS STRING)", "ord": "CAST(c_custkey AS INT)", "at": "0",
    "kind": "CASE c_nationkey % 3 WHEN 0 THEN 'kit' WHEN 1 THEN 'host' ELSE 'local' END", "name": "c_mktsegment", "slot": "CASE WHEN c_custkey % 5 = 0 THEN 'icon' END"}


@query("applied_to", f"""
WITH v AS (SELECT p_partkey, 'f' || p_partkey % 40 || '.css' AS file, {CLASSES.replace("array(", "list_value(")} AS classes FROM part),
r AS (SELECT {", ".join(f'{x} AS "{c}"' for c, x in REFS.items())} FROM customer), t AS (SELECT module, "className", arg_min({{'kind': kind, 'name': name, 'slot': slot}}, {{'file': file, 'ord': ord}}) AS target FROM r GROUP BY ALL),
c AS (SELECT p_partkey, file, unnest(classes) AS "className", generate_subscripts(classes, 1) AS pos FROM v),
b AS (SELECT p_partkey, arg_min(target, pos) AS target FROM c JOIN t ON t.module = c.file AND t."className" = c."className" GROUP BY 1)
SELECT p_partkey, CASE WHEN len(classes) > 0 THEN coalesce(target.kind, 'unused') END AS kind, target.name AS name, target.slot AS slot FROM v LEFT JOIN b USING (p_partkey)""")
def applied_to(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey", "'f' || CAST(p_partkey % 40 AS STRING) || '.css' AS file", f"cast({CLASSES} as array<string>) AS classNames").withColumn("appliedTo", F.lit(None).cast(classes.TARGET))
    refs = table(spark, sf, "customer").selectExpr(*(f"{x} AS `{c}`" for c, x in REFS.items()))
    return classes.link_applied_to(rows, refs).select("p_partkey", "appliedTo.kind", "appliedTo.name", "appliedTo.slot")


@query("selector_targets", """
WITH s AS (SELECT p_partkey, p_size, p_partkey % 4 AS tail, CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text-field' WHEN 2 THEN 'text-field-icon' WHEN 3 THEN 'other' ELSE 'button' END AS class FROM part),
k AS (SELECT *, '.kx-' || class || '-p' || p_size || CASE tail WHEN 0 THEN '' WHEN 1 THEN ' span' WHEN 2 THEN ', a' ELSE ' .kx-button' END AS selector FROM s)
SELECT DISTINCT selector, CASE WHEN class IN ('text') THEN 'Text' WHEN class LIKE 'text-field%' THEN 'TextField' ELSE 'Button' END AS component,
       CASE WHEN class = 'other' THEN NULL WHEN class = 'text-field-icon' THEN 'icon-p' || p_size ELSE 'p' || p_size END AS slot, CASE WHEN class = 'other' THEN false ELSE tail IN (1, 3) END AS inner
FROM k WHERE class <> 'other' OR tail = 3""")
def selector_targets(spark: SparkSession, sf: str) -> DataFrame:
    kind = "CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text-field' WHEN 2 THEN 'text-field-icon' WHEN 3 THEN 'other' ELSE 'button' END"
    rows = table(spark, sf, "part").selectExpr(f"'.kx-' || {kind} || '-p' || CAST(p_size AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' span' WHEN 2 THEN ', a' ELSE ' .kx-button' END AS selector")
    layers = spark.createDataFrame([("text", "Text"), ("text-field", "TextField"), ("button", "Button")], "layer string, component string")
    return classes.selector_targets(rows, layers, "kx")


@query("kit_closure", """
WITH RECURSIVE e AS (
  SELECT 'm' || c_custkey || '.ts' AS file, 'm' || c_custkey // 3 || '.ts' AS target, c_custkey % 11 = 0 AS star, 'N' || c_nationkey AS name, c_custkey % 4 = 0 AS type_only FROM customer WHERE c_custkey // 3 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'm' || c_custkey || '.ts', CASE WHEN c_custkey % 40 = 20 THEN '@base/ui' ELSE '@kit/core' END, false, 'K', false FROM customer WHERE c_custkey % 20 = 0),
k(source) AS (SELECT '@kit/core' UNION SELECT file FROM e JOIN k ON target = source),
b AS (SELECT file, bool_or(star) AS star, coalesce(list_sort(list(DISTINCT name) FILTER (NOT star AND NOT type_only)), []) AS names, list_sort(list(DISTINCT target)) AS via FROM e JOIN k ON target = source GROUP BY file)
SELECT file AS source, 'project-barrel' AS kind, star, array_to_string(names, ',') AS names, array_to_string(via, ',') AS via FROM b
UNION ALL SELECT '@kit/core', 'package', true, '', 'declared kit package' UNION ALL SELECT '@base/ui', 'wrapped-upstream', true, '', 'wrapped by the kit'""")
def kit_closure(spark: SparkSession, sf: str) -> DataFrame:
    c = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    names = "array(named_struct('exported', {0}, 'local', {0}, 'typeOnly', {1}))"
    own = "'m' || CAST(c_custkey AS STRING) || '.ts' AS file"
    inner = c.selectExpr(own, "'./m' || CAST(c_custkey div 3 AS STRING) AS specifier", names.format("'N' || CAST(c_nationkey AS STRING)", "c_custkey % 4 = 0") + " AS names", "c_custkey % 11 = 0 AS star")
    outer = c.where("c_custkey % 20 = 0").selectExpr(own, "CASE WHEN c_custkey % 40 = 20 THEN '@base/ui' ELSE '@kit/core/x' END AS specifier", names.format("'K'", "false") + " AS names", "false AS star")
    links = inner.unionByName(outer)
    packages = spark.createDataFrame([("@kit/core",), ("@kit/other",)], "package string")
    found = kit.kit_closure(links.select("file", "specifier").where("false"), links, c.selectExpr(own), packages, "@base")
    return found.select("source", "kind", "star", F.array_join("names", ",").alias("names"), F.array_join("via", ",").alias("via"))


@query("scss_variables", """
WITH RECURSIVE v AS (SELECT c_custkey AS id, c_custkey % 4 = 0 AS plain FROM customer),
chain(start, here, depth) AS (SELECT id, id, 0 FROM v UNION ALL SELECT start, here // 2, depth + 1 FROM chain JOIN v ON v.id = here WHERE NOT plain AND depth < 7),
ends AS (SELECT start, here FROM chain JOIN v ON v.id = here WHERE plain)
SELECT 's/f' || id % 20 || '.scss' AS file, 'v' || id AS name, here || 'px' AS resolved, 's/f' || here % 20 || '.scss' AS root_file, 'v' || here AS root
FROM v LEFT JOIN ends ON start = id""")
def scss_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty stylesheets that use each other: a variable is a length, or the variable of half its number in its own file."""
    c = table(spark, sf, "customer").selectExpr("c_custkey % 20 AS k", "c_custkey AS id", "'$v' || CAST(c_custkey AS STRING) || ': ' || CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS STRING) || 'px' "
                                                "ELSE 'n' || CAST((c_custkey div 2) % 20 AS STRING) || '.$v' || CAST(c_custkey div 2 AS STRING) END || ';' AS text")
    uses = "\n".join(f"@use './f{i}' as n{i};" for i in range(20))
    sheets = c.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    files = sheets.select(F.concat(F.lit("s/f"), F.col("k").cast("string"), F.lit(".scss")).alias("file"), F.concat(F.lit(uses + "\n"), F.col("text")).cast("binary").alias("content"))
    declared, _ = scss.variables(files)
    return declared.select("file", "name", "resolved", F.col("root.file").alias("root_file"), F.col("root.name").alias("root"))


NEXT = "CASE c_custkey % 100 WHEN 99 THEN c_custkey + 1 WHEN 0 THEN c_custkey - 1 ELSE CASE WHEN c_custkey < 2 THEN NULL ELSE CAST(floor(c_custkey / 2) AS BIGINT) END END"


@query("render_resolve", f"""
WITH RECURSIVE n AS (SELECT c_custkey::BIGINT AS node, {NEXT} AS next FROM customer),
w(start, here, path) AS (SELECT node, node, [node] FROM n UNION ALL SELECT start, next, list_append(path, next) FROM w JOIN n ON node = here WHERE next IS NOT NULL AND NOT list_contains(path, next)),
e AS (SELECT start, here, path FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE node = here AND next IS NOT NULL))
SELECT node AS start, here AS "end", array_to_string(path, '>') AS path FROM n LEFT JOIN e ON start = node""")
def render_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """What each node renders in the end, and by way of which; circles render nothing that is known."""
    steps = table(spark, sf, "customer").selectExpr("cast(c_custkey as bigint) AS node", f"cast({NEXT} as bigint) AS next")
    return graph.resolve_paths(steps).select("start", "end", F.array_join("path", ">").alias("path"))
