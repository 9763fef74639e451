"""Further rules over facts that are made from the driver tables: each query calls the rule, each statement restates it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom import schemas
from sparkloom.plans import rules, rules_kit
from sparkloom.plans.catalog import query
from sparkloom.plans.project import IMPORTS, imports, report
from sparkloom.plans.rollups import table


def filled(rows: DataFrame, schema: str) -> DataFrame:
    """The rows in the shape of a fact table; what they lack is null."""
    want = StructType.fromDDL(schema)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


LINT = {"file": "'l' || CAST(user_id % 50 AS STRING)", "line": "CAST(event_id AS INT)", "rule": "CASE event_type WHEN 'error' THEN 'alt-text' WHEN 'purchase' THEN 'lang' ELSE 'own-rule' END", "message": "event_type || '!'"}


@query("rule_lint", f"""
WITH m AS (SELECT {", ".join(f'{x} AS "{c}"' for c, x in LINT.items())} FROM events)
SELECT 'a11y.lint' AS rule, rule AS subkind, CASE rule WHEN 'alt-text' THEN 'error' WHEN 'lang' THEN 'warning' ELSE 'info' END AS severity, CASE rule WHEN 'alt-text' THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence, file, line, message AS actual,
       NULL::VARCHAR AS expected, 'a11y.lint:' || rule AS "impactKey" FROM m""")
def rule_lint(spark: SparkSession, sf: str) -> DataFrame:
    rows = filled(table(spark, sf, "events").selectExpr(*(f"{x} AS `{c}`" for c, x in LINT.items())), schemas.LINT_MESSAGES)
    return report(rules.lint(rules.Tables(lint_messages=rows)))


@query("rule_deprecated", f"""
WITH {IMPORTS}, u AS (
  SELECT 'e' || c_custkey % 30 AS file, (c_custkey // 7)::INT AS line, 'Kit' || c_nationkey % 4 AS symbol FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT file, line, 'Old' || line % 5 FROM i)
SELECT DISTINCT 'api.deprecated' AS rule, NULL::VARCHAR AS subkind, 'warning' AS severity, 1.0::DOUBLE AS confidence, file, line, symbol AS actual, CASE symbol WHEN 'Kit1' THEN 'use Kit2' WHEN 'Old3' THEN 'gone' END AS expected,
       'api.deprecated:' || symbol AS "impactKey" FROM u WHERE symbol IN ('Kit1', 'Old3')""")
def rule_deprecated(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("'e' || CAST(c_custkey % 30 AS STRING) AS file", "CAST(c_custkey div 7 AS INT) AS line", "1 AS column", "CAST(c_custkey AS INT) AS ord", "'Kit' || CAST(c_nationkey % 4 AS STRING) AS kitComponent")
    named = imports(spark, sf).withColumn("names", F.expr("array(named_struct('imported', 'Old' || CAST(line % 5 AS STRING), 'local', 'x', 'typeOnly', false))"))
    symbols = spark.createDataFrame([("Kit1", "use Kit2"), ("Old3", "gone"), ("Never", "x")], "name string, note string")
    return report(rules.api_deprecated(rules.Tables(elements=filled(used, schemas.ELEMENTS), imports=named, symbols=symbols)))


VALUE = "CASE c_custkey % 4 WHEN 0 THEN 'larg' WHEN 1 THEN 'small' WHEN 2 THEN 'LARGE' ELSE 'xx' END"


@query("rule_prop_invalid", f"""
WITH e AS (SELECT 'e' || c_custkey % 30 AS file, c_custkey::INT AS line, {VALUE} AS value FROM customer WHERE c_custkey % 3 = 0)
SELECT 'prop.invalid' AS rule, NULL::VARCHAR AS subkind, 'error' AS severity, 1.0::DOUBLE AS confidence, file, line, value AS actual, CASE value WHEN 'larg' THEN 'large' END AS expected, 'prop.invalid:Button.size=' || value AS "impactKey" FROM e WHERE value <> 'small'""")
def rule_prop_invalid(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr("'e' || CAST(c_custkey % 30 AS STRING) AS file", "CAST(c_custkey AS INT) AS line", "CASE WHEN c_custkey % 3 = 0 THEN 'Button' END AS kitComponent", f"map('size', {VALUE}, 'kind', 'any') AS props")
    variants = spark.createDataFrame([("Button", "size", ["small", "large"])], "component string, prop string, legal array<string>")
    return report(rules.prop_invalid(rules.Tables(elements=filled(rows, schemas.ELEMENTS), variants=variants)))


NAMED = {
    "file": "'e' || CAST(c_custkey % 30 AS STRING)", "line": "CAST(c_custkey AS INT)", "name": "CASE c_nationkey % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'span' WHEN 3 THEN 'label' ELSE 'img' END",
    "text": "CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'some' END", "label": "CASE WHEN c_custkey % 4 = 0 THEN 'named' END", "id": "CAST(c_custkey % 997 AS STRING)", "around": "c_custkey % 13 = 0"}


@query("rule_name_missing", f"""
WITH e AS (SELECT {", ".join(f'{x} AS "{c}"' for c, x in NAMED.items())} FROM customer), l AS (SELECT DISTINCT file, id FROM e WHERE name = 'label')
SELECT 'a11y.name.missing' AS rule, CASE name WHEN 'img' THEN 'unlabelled' ELSE 'iconOnly' END AS subkind, 'error' AS severity, 0.9::DOUBLE AS confidence, file, line, name AS actual, NULL::VARCHAR AS expected,
       'a11y.name.missing:' || CASE name WHEN 'a' THEN 'link' ELSE name END AS "impactKey"
FROM e WHERE name IN ('button', 'a', 'img') AND trim(coalesce(text, '')) = '' AND label IS NULL AND NOT around AND NOT EXISTS (SELECT 1 FROM l WHERE l.file = e.file AND l.id = e.id)""")
def rule_name_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(*(f"{x} AS `{c}`" for c, x in NAMED.items()))
    props = F.map_concat(F.create_map(F.when(F.col("name") == "label", "htmlFor").otherwise("id"), F.col("id")), F.when(F.col("label").isNotNull(), F.create_map(F.lit("aria-label"), F.col("label"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("props", props).withColumn("propExpressions", F.create_map().cast("map<string,string>")).withColumn("hasLabelAncestor", F.col("around"))
    return report(rules.name_missing(rules.Tables(elements=filled(rows, schemas.ELEMENTS))))


@query("rule_duplicate", """
WITH u AS (SELECT 'C' || o_custkey AS name, count(*) AS usages, count(DISTINCT o_orderkey % 50) AS files FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, 'C' || c_custkey AS name, c_custkey % 97 AS kind, coalesce(usages, 0) AS usages, coalesce(files, 0) AS files FROM customer LEFT JOIN u ON u.name = 'C' || c_custkey),
g AS (SELECT kind, count(*) AS members, arg_min({'name': name, 'id': id}, {'u': -usages, 'f': -files, 'n': name}) AS best FROM c GROUP BY kind HAVING count(*) > 1)
SELECT 'component.duplicate' AS rule, NULL::VARCHAR AS subkind, 'candidate' AS severity, 0.9::DOUBLE AS confidence, 'd' || best.id % 40 AS file, best.id::INT AS line, best.name AS actual, members::VARCHAR AS expected, 'component.duplicate:' || best.name AS "impactKey" FROM g""")
def rule_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").selectExpr(
        "'d' || CAST(c_custkey % 40 AS STRING) AS file", "CAST(c_custkey AS INT) AS line", "1 AS column", "CAST(c_custkey AS INT) AS ord", "'C' || CAST(c_custkey AS STRING) AS name", "'component' AS kind", "1 AS elementCount",
        "transform(sequence(0, 59), i -> 't' || CAST(c_custkey % 97 AS STRING) || '_' || CAST(i % 50 AS STRING)) AS astSignature")
    used = table(spark, sf, "orders").selectExpr("'f' || CAST(o_orderkey % 50 AS STRING) AS file", "'C' || CAST(o_custkey AS STRING) AS name")
    return report(rules_kit.component_duplicate(rules.Tables(declarations=filled(own, schemas.DECLARATIONS), elements=filled(used, schemas.ELEMENTS))))
