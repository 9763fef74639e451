"""Operators of dictionaries, edits, settings and reports over the driver tables; each query calls the operator it names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import edits, style
from sparkloom.operators import dictionary, limits
from sparkloom.plans.catalog import query
from sparkloom.plans.project import IMPORTS, STYLES, imports, style_values
from sparkloom.plans.rollups import table
from sparkloom.sources import settings


@query("property_classes", f"""
WITH {STYLES}
SELECT ord, CASE property WHEN 'color' THEN 'foreground' WHEN 'outline' THEN 'border' END AS role, CASE property WHEN 'border-radius' THEN 'borderRadiusPx' WHEN 'font-size' THEN 'fontSizePx' WHEN 'outline' THEN 'borderWidthPx' WHEN 'padding' THEN 'none' WHEN 'gap' THEN 'none' END AS scale,
       CASE WHEN property = 'padding' THEN 'size' WHEN property IN ('gap', 'width') THEN 'layout' ELSE 'repaint' END AS category FROM v""")
def property_classes(spark, sf):
    p = F.col("property")
    return style_values(spark, sf).select("ord", style.color_role(p).alias("role"), style.dimension_scale(p).alias("scale"), style.style_category(p).alias("category"))


@query("svg_fingerprints", """
WITH s AS (SELECT p_partkey, 'circle:' || p_size || '  ' || (p_size % 4 + 0.5)::DOUBLE || '|path:M' || p_partkey % 7 || ' 1.25Z' AS shape FROM part)
SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(shape, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::UBIGINT))), 8, '0') AS fingerprint FROM s""")
def svg_fingerprints(spark, sf):
    svg = F.concat(F.lit("<svg><g><circle r='"), (F.col("p_size") % 4).cast("string"), F.lit(".500' cx=\""), F.col("p_size").cast("string"), F.lit("\"/><path d='M "), (F.col("p_partkey") % 7).cast("string"), F.lit(",1.2501 Z'/></g></svg>"))
    return table(spark, sf, "part").select("p_partkey", style.svg_fingerprint(svg).alias("fingerprint"))


@query("line_edits", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE ' b' END AS deleted, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  a("' || c_name || '") c;' END AS patched, 3 + CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 0 END + c_nationkey AS "column" FROM customer""")
def line_edits(spark, sf):
    line = F.concat(F.lit('  a("'), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, '") c;').otherwise('") b c;'))
    source = F.when(F.col("c_custkey") % 2 == 0, "css").otherwise("jss")
    return table(spark, sf, "customer").select("c_custkey", edits.deletion_of(line, F.lit("b c").substr(1, 1)).alias("deleted"), edits.patched(line, F.lit(" b"), F.lit("")).alias("patched"), edits.literal_column(F.lit(3), source, F.lit("color"), F.col("c_nationkey")).alias("column"))


@query("theme_values", """
WITH v AS (SELECT n_nationkey AS k, n_nationkey - n_nationkey % 5 AS root, unnest(['light', 'dark']) AS mode FROM nation)
SELECT '--v' || k AS name, mode, '1px #' || CASE WHEN mode = 'dark' AND root % 10 = 0 THEN 'dark' ELSE root::VARCHAR END AS value FROM v""")
def theme_values(spark, sf):
    n = F.col("n_nationkey")
    own = F.concat(F.lit("1px #"), n.cast("string"))
    # a chain of references ends at every fifth variable, and has its text before it there
    value = F.when(n % 5 == 0, own).otherwise(F.concat(F.lit("var(--v"), (n - 1).cast("string"), F.lit(")")))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("--v"), n.cast("string")).alias("name"), F.lit("light").alias("mode"), value.alias("value"), n.alias("n"))
    dark = rows.where("n % 10 = 0").select("name", F.lit("dark").alias("mode"), F.lit("1px #dark").alias("value"))
    return dictionary.theme_values(rows.select("name", "mode", "value").unionByName(dark)).select("name", "mode", "value")


@query("token_kinds", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'fontSize' WHEN p_size % 3 = 0 THEN 'color' WHEN p_size % 3 = 1 THEN 'dimension' ELSE 'other' END AS kind FROM part""")
def token_kinds(spark, sf):
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("sys.FontSize."), F.col("p_brand"))).otherwise(F.concat(F.lit("ref."), F.col("p_type")))
    value = F.element_at(F.array(F.lit("#aabbcc"), F.lit("4px"), F.col("p_name")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", dictionary.token_kind(path, value).alias("kind"))


@query("recipe_variants", """SELECT p_brand AS name, p_type AS prop, array_to_string(list_sort(list(DISTINCT p_size::VARCHAR)), ',') AS "values" FROM part GROUP BY 1, 2""")
def recipe_variants(spark, sf):
    groups = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("prop"), F.array(F.col("p_size").cast("string")).alias("values"))
    return dictionary.recipe_variants(groups).select("name", "prop", F.array_join("values", ",").alias("values"))


@query("public_symbols", """
WITH s AS (SELECT n_nationkey AS k, 'n' || (n_nationkey % 9) AS name, n_name AS origin FROM nation), a AS (SELECT name, min(origin) AS origin FROM s WHERE k < 5 GROUP BY name), b AS (SELECT name, min(origin) AS origin FROM s WHERE k >= 5 GROUP BY name)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.origin, b.origin) AS origin, r.r_name AS owner FROM a FULL JOIN b ON a.name = b.name LEFT JOIN nation n ON n.n_name = coalesce(a.origin, b.origin) LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def public_symbols(spark, sf):
    nation = table(spark, sf, "nation")
    lists = [nation.where(c).select(F.concat(F.lit("n"), (F.col("n_nationkey") % 9).cast("string")).alias("name"), F.col("n_name").alias("origin")) for c in ("n_nationkey < 5", "n_nationkey >= 5")]
    owners = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("file"), F.col("r_name").alias("owner"))
    return dictionary.public_symbols(lists, owners)


@query("external_dependencies", f"""
WITH {IMPORTS} SELECT DISTINCT 'i' || regexp_extract(file, '[0-9]') AS directory, CASE WHEN starts_with(specifier, '@') THEN string_split(specifier, '/')[1] || '/' || string_split(specifier, '/')[2] ELSE string_split(specifier, '/')[1] END AS package FROM i WHERE NOT starts_with(specifier, '.')""")
def external_dependencies(spark, sf):
    below = imports(spark, sf).withColumn("file", F.concat(F.lit("i"), F.regexp_extract("file", "[0-9]", 0), F.lit("/"), F.col("file")))
    return dictionary.external_dependencies(below)


@query("asset_lists", """
SELECT p_brand AS directory, CASE p_size % 3 WHEN 0 THEN 'stories' ELSE 'docs' END AS kind, md5(string_agg(p_brand || '/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.stories.tsx' ELSE '.md' END, ',' ORDER BY p_brand || '/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.stories.tsx' ELSE '.md' END)) AS files
FROM part WHERE p_size % 3 < 2 GROUP BY 1, 2""")
def asset_lists(spark, sf):
    tail = F.element_at(F.array(F.lit(".stories.tsx"), F.lit(".md"), F.lit(".tsx")), (F.col("p_size") % 3 + 1).cast("int"))
    files = table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), tail).alias("file"))
    return dictionary.assets(files).select("directory", "kind", F.md5(F.array_join("files", ",")).alias("files"))


@query("new_findings", """
SELECT event_id FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id % 2 = 1 AND k.user_id % 4 <> 0 AND k.user_id = e.user_id AND k.event_type = e.event_type)""")
def new_findings(spark, sf):
    e = table(spark, sf, "events")
    return limits.new_only(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 and user_id % 4 <> 0"), ["user_id", "event_type"]).select("event_id")


@query("not_checked", """
SELECT 'f' || (event_id % 9) AS file, event_id::INT AS line, CASE event_type WHEN 'error' THEN 'spec-unavailable' ELSE 'unsupported-syntax' END AS reason FROM events WHERE event_type IN ('error', 'view')""")
def not_checked(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("file"), F.col("event_id").cast("int").alias("line"), "event_type")
    parts = [limits.limitation(e.where(F.col("event_type") == t), reason, t) for t, reason in (("error", "spec-unavailable"), ("view", "unsupported-syntax"), ("click", "file-too-large"))]
    return limits.not_checked(limits.all_limitations(*parts)).select("file", "line", "reason")


@query("settings_merged", """
SELECT o_orderkey, 'p:' || CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'off' END || ';q:on' || CASE WHEN o_orderkey % 2 = 0 THEN ';s:info' ELSE '' END AS packed FROM orders""")
def settings_merged(spark, sf):
    """Overrides as a text, read, laid over a base and packed again; entries of an unknown level fall away."""
    text = F.concat(F.lit("p:"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("off"), F.when(F.col("o_orderkey") % 2 == 0, ";s:info").otherwise(";s:loud"), F.lit(";"))
    base = F.create_map(F.lit("p"), F.lit("on"), F.lit("q"), F.lit("on"))
    return table(spark, sf, "orders").select("o_orderkey", settings.pack_overrides(settings.merged(base, settings.parse_overrides(text))).alias("packed"))
