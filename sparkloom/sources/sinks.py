"""Report documents from findings: per-file JSON, SARIF, compact text, summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numbers import severity_rank, severity_weight

#: Fixed values of the formats.
SARIF_LEVEL = {"error": "error", "warning": "warning", "info": "note", "candidate": "note"}


def per_file_json(findings: DataFrame) -> DataFrame:
    """file and one JSON document: messages in order with severity 2 or 1, counts. One row a file, sorted by path."""
    message = F.struct("line", "column", F.col("rule").alias("ruleId"), F.when(F.col("severity") == "error", 2).otherwise(1).alias("severity"), F.col("actual").alias("message"))
    g = findings.groupBy("file").agg(F.sort_array(F.collect_list(message)).alias("messages"), F.count_if(F.col("severity") == "error").alias("errorCount"), F.count_if(F.col("severity") != "error").alias("warningCount"))
    return g.select("file", F.to_json(F.struct(F.col("file").alias("filePath"), "messages", "errorCount", "warningCount")).alias("document")).orderBy("file")


def sarif_results(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """SARIF result objects as JSON, with the rule's index in the catalog (id)."""
    index = catalog.select(F.col("id").alias("rule"), (F.row_number().over(Window.orderBy("id")) - 1).alias("ruleIndex"))  # one row a rule
    level = F.create_map(*(F.lit(x) for kv in SARIF_LEVEL.items() for x in kv))[F.col("severity")]
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")).alias("physicalLocation"))
    return findings.join(index, "rule", "left").select("id", F.to_json(F.struct(
        F.col("rule").alias("ruleId"), "ruleIndex", level.alias("level"), F.struct(F.col("actual").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct("impactKey").alias("partialFingerprints"))).alias("result"))


def sarif_document(results: list[str], rule_ids: list[str], tool: str) -> str:
    """The SARIF 2.1.0 shell around results; driver-side, for report-sized inputs."""
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in sorted(rule_ids)]}}, "results": [json.loads(r) for r in results]}]})


def compact(findings: DataFrame, width: int = 60) -> DataFrame:
    """file, ord, text: places padded per file, long texts cut."""
    place = F.concat_ws(":", F.col("line").cast("string"), F.col("column").cast("string"))
    w = Window.partitionBy("file")
    short = F.when(F.length("actual") > width, F.concat(F.substring("actual", 1, width - 1), F.lit("…"))).otherwise(F.col("actual"))
    return findings.withColumn("_p", place).withColumn("_w", F.max(F.length("_p")).over(w)).select(
        "file", "line", "column", F.concat(F.expr("lpad(_p, _w, ' ')"), F.lit("  "), F.rpad("severity", 9, " "), F.lit("  "), short, F.lit("  "), F.col("rule")).alias("text"))


def summary(findings: DataFrame, files: int) -> DataFrame:
    """One row: totals by severity, files, weight and the five heaviest problems."""
    top = findings.groupBy("impactKey").agg(F.sum(severity_weight(F.col("severity"))).alias("weight"), F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("worst")).orderBy(F.desc("weight"), F.desc("n"), "impactKey").limit(5)
    best = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("n")).alias("n"), "impactKey"))), lambda x: x["impactKey"]).alias("top"))
    total = findings.agg(F.count("*").alias("findings"), F.countDistinct("file").alias("dirty"), *(F.count_if(F.col("severity") == s).alias(s) for s in SARIF_LEVEL))
    return total.join(F.broadcast(best)).withColumn("files", F.lit(files)).withColumn("clean", F.col("files") - F.col("dirty"))  # one row each
