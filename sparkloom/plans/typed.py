"""Typed facts of scripts that are written from parts, and invalid values of props whose legal set comes from those types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.plans import rules
from sparkloom.plans.catalog import query
from sparkloom.plans.project import report
from sparkloom.plans.rollups import table
from sparkloom.plans.rule_queries import filled
from sparkloom.scratch import spread
from sparkloom.sources import token_paths, typed

#: One script a part; {k} is its key, {size} its size, {old} a mark on every third, {word} its type.
SCRIPT = """/**
 * Tones.
 * {old}
 */
export type Tone{k} = 'calm{k}' | "{word}" // all
export const Size{k} = {
  /** {old} */
  sm: 'small{k}',
  'x-l': {size},
  ...rest,
} as const
export interface Box{k}Props<T> extends Base<T, 'a'>, Other {
  /** How big. */
  size?: keyof typeof Size{k};
  tone: Tone{k} | 'c' | undefined
  other: Tone{next} | null, onChange(e: { a: 1 }): void
  free: string
}
export type Box{k}Classes = { root: string; /** {old} */ icon?: string } & More{k};
export const theme = {
  bg: {
    // {old}
    accent: '1',
    deep{k}: {
      /** {old} */
      b: 2 } } }
"""
MARK = "CASE WHEN p_partkey % 3 = 0 THEN '@deprecated' ELSE 'kept' END"


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lit(SCRIPT)
    for name, value in {"k": "CAST(p_partkey AS STRING)", "next": "CAST(p_partkey + 1 AS STRING)", "size": "CAST(p_size AS STRING)", "old": MARK, "word": "p_type"}.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.expr(value))
    return spread(table(spark, sf, "part"), "p_partkey").select(F.format_string("c%d.ts", "p_partkey").alias("file"), text.cast("binary").alias("content"))


@query("variant_sets", """
SELECT 'c' || p_partkey || '.ts' AS file, 6::INT AS line, 'Size' || p_partkey AS name, 'constObject' AS kind, 'sm,x-l' AS keys, 'small' || p_partkey || ',' || p_size AS "values", CASE WHEN p_partkey % 3 = 0 THEN 'sm' ELSE '' END AS deprecated FROM part
UNION ALL SELECT 'c' || p_partkey || '.ts', 5, 'Tone' || p_partkey, 'literalUnion', 'calm' || p_partkey || ',' || p_type, '', CASE WHEN p_partkey % 3 = 0 THEN 'calm' || p_partkey || ',' || p_type ELSE '' END FROM part""")
def variant_sets(spark, sf):
    joined = lambda c: F.array_join(c, ",")
    return typed.variant_sets(scripts(spark, sf)).select("file", "line", "name", "kind", joined("keys").alias("keys"), joined(F.array_compact(F.transform("keys", lambda k: F.col("values")[k]))).alias("values"), joined("deprecatedKeys").alias("deprecated"))


@query("props_types", """
WITH m AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3, 4]) AS i FROM part)
SELECT 'c' || k || '.ts' AS file, 12::INT AS line, 'Box' || k || 'Props' AS name, 'Base<T, ''a''>;Other' AS bases, ['size', 'tone', 'other', 'onChange', 'free'][i + 1] AS member, i = 0 AS optional,
 ['keyof typeof Size' || k, 'Tone' || k || ' | ''c'' | undefined', 'Tone' || k + 1 || ' | null', '(e: { a: 1 }): void', 'string'][i + 1] AS type, CASE WHEN i = 0 THEN 'How big.' END AS doc FROM m""")
def props_types(spark, sf):
    rows = typed.props_types(scripts(spark, sf)).select("file", "line", "name", F.array_join("extends", ";").alias("bases"), F.explode("members").alias("m"))
    return rows.select("file", "line", "name", "bases", F.col("m.name").alias("member"), "m.optional", "m.type", "m.doc")


@query("slot_sets", """
SELECT 'c' || p_partkey || '.ts' AS file, 'Box' || p_partkey || 'Classes' AS name, 'More' || p_partkey AS bases, 'root,icon' AS slots, CASE WHEN p_partkey % 3 = 0 THEN 'icon' ELSE '' END AS deprecated FROM part""")
def slot_sets(spark, sf):
    names = lambda rows: F.array_join(F.transform(rows, lambda m: m["name"]), ",")
    return typed.slot_sets(scripts(spark, sf)).select("file", "name", F.array_join("extends", ";").alias("bases"), names(F.col("members")).alias("slots"), names(F.filter("members", lambda m: m["deprecated"])).alias("deprecated"))


@query("deprecated_paths", """
WITH p AS (SELECT p_partkey AS k, unnest([0, 1]) AS i FROM part WHERE p_partkey % 3 = 0)
SELECT 'c' || k || '.ts' AS file, CASE i WHEN 0 THEN 23 ELSE 26 END::INT AS line, CASE i WHEN 0 THEN 'bg.accent' ELSE 'bg.deep' || k || '.b' END AS path FROM p""")
def deprecated_paths(spark, sf):
    return typed.deprecated_paths(scripts(spark, sf), "theme").select("file", "line", "path")


LEGAL = """l AS (
 SELECT 'Box' || p_partkey AS component, 'size' AS prop, ['sm', 'x-l'] AS legal FROM part UNION ALL SELECT 'Box' || p_partkey, 'tone', list_sort(list_distinct(['c', 'calm' || p_partkey, p_type])) FROM part
 UNION ALL SELECT 'Box' || a.p_partkey, 'other', list_sort(list_distinct(['calm' || b.p_partkey, b.p_type])) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


@query("legal_values", f"WITH {LEGAL} SELECT component, prop, array_to_string(legal, ',') AS legal FROM l")
def legal_values(spark, sf):
    files = scripts(spark, sf)
    return typed.legal_values(typed.props_types(files), typed.variant_sets(files)).select("component", "prop", F.array_join("legal", ",").alias("legal"))


@query("rule_prop_invalid_typed", f"""
WITH {LEGAL}, e AS (SELECT 'e' || p_partkey % 30 AS file, p_partkey::INT AS line, 'Box' || p_partkey AS component, 'tone' AS prop, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'calmm' || p_partkey ELSE 'zzz' END AS value FROM part),
 f AS (SELECT e.*, list_filter(l.legal, lambda x: levenshtein(e.value, x) <= greatest(1, length(e.value) // 2)) AS near FROM e JOIN l USING (component, prop) WHERE NOT list_contains(l.legal, e.value))
SELECT 'prop.invalid' AS rule, NULL::VARCHAR AS subkind, 'error' AS severity, 1.0::DOUBLE AS confidence, file, line, value AS actual, CASE WHEN len(near) > 0 THEN list_sort(list_transform(near, lambda x: {{'d': levenshtein(value, x), 'x': x}}))[1].x END AS expected,
       'prop.invalid:' || component || '.tone=' || value AS "impactKey" FROM f""")
def rule_prop_invalid_typed(spark, sf):
    files = scripts(spark, sf)
    value = "CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'calmm' || CAST(p_partkey AS STRING) ELSE 'zzz' END"
    rows = table(spark, sf, "part").selectExpr("'e' || CAST(p_partkey % 30 AS STRING) AS file", "CAST(p_partkey AS INT) AS line", "'Box' || CAST(p_partkey AS STRING) AS kitComponent", f"map('tone', {value}, 'free', 'any') AS props")
    legal = typed.legal_values(typed.props_types(files), typed.variant_sets(files))
    return report(rules.prop_invalid(rules.Tables(elements=filled(rows, schemas.ELEMENTS), variants=legal)))


#: One style file a part: members, a namespace, templates and spreads, of which every fourth hangs on a local name.
STYLE_FILE = """import { style as s, recipe } from '@vanilla-extract/css'
import { tokens as t } from '@kit/theme'
import * as all from '@kit/{word}'
export const box{k} = style({
  color: t.sys.c{k},
  padding: `${t.space.s} ${t.space.m}`,
  ':hover': { fill: all.colors['{word}'], ...{root}.type.b{size} },
  stroke: t.list[{size}],
})
"""
SPREAD_ROOT = "CASE WHEN p_partkey % 4 = 0 THEN 'local' ELSE 't' END"


def style_files(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lit(STYLE_FILE)
    for name, value in {"k": "CAST(p_partkey AS STRING)", "size": "CAST(p_size AS STRING)", "word": "p_type", "root": SPREAD_ROOT}.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.expr(value))
    return spread(table(spark, sf, "part"), "p_partkey").select(F.format_string("s%d.ts", "p_partkey").alias("file"), text.cast("binary").alias("content"))


@query("token_references", """
WITH p AS (SELECT p_partkey AS k, p_type AS t, p_size AS s FROM part)
SELECT 's' || k || '.ts' AS file, 5::INT AS line, 'box' || k AS owner, NULL::VARCHAR AS selector, 'color' AS property, false AS spread, '@kit/theme' AS module, 'tokens' AS exported, 'sys.c' || k AS path FROM p
UNION ALL SELECT 's' || k || '.ts', 6, 'box' || k, NULL, 'padding', false, '@kit/theme', 'tokens', 'space.s' FROM p UNION ALL SELECT 's' || k || '.ts', 7, 'box' || k, ':hover', 'fill', false, '@kit/' || t, 'colors', t FROM p
UNION ALL SELECT 's' || k || '.ts', 7, 'box' || k, ':hover', '...', true, '@kit/theme', 'tokens', 'type.b' || s FROM p WHERE k % 4 <> 0""")
def token_references(spark, sf):
    references, _ = token_paths.token_references(style_files(spark, sf))
    return references.select("file", "line", "owner", "selector", "property", "spread", "module", F.col("exportName").alias("exported"), F.array_join("path", ".").alias("path"))


@query("unexpandable_spreads", """
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT 's' || k || '.ts' AS file, 7::INT AS line, '...t.type.b' || s || ' - spread that the dictionary cannot expand' AS detail FROM p WHERE k % 4 <> 0 AND s > 20
UNION ALL SELECT 's' || k || '.ts', 7, '...local.type.b' || s || ' - spread is no path of an import' FROM p WHERE k % 4 = 0 UNION ALL SELECT 's' || k || '.ts', 8, 'stroke: t.list[' || s || '] - computed member in a token reference' FROM p""")
def unexpandable_spreads(spark, sf):
    """What the style files leave unread, and spreads that a dictionary of the smaller sizes cannot expand."""
    references, unread = token_paths.token_references(style_files(spark, sf))
    known = table(spark, sf, "part").where("p_size <= 20").select(F.lit("@kit/theme").alias("module"), F.lit("tokens").alias("exportName"), F.array(F.lit("type"), F.format_string("b%d", "p_size")).alias("path"))
    return token_paths.unexpandable_spreads(references, known).unionByName(unread).select("file", "line", "detail")
