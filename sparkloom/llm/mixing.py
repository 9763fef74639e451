"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule w(t) = target * (1 + slope * (2t - 1)) over training time t in [0, 1]; its
integral over the whole run is the source's target. A document's place in its source's stream (a fixed pseudo-random
order, read round and round for up to ``cap`` passes) is a cumulative token demand; inverting the integrated schedule
at that demand gives the training position, by which the result is range-sorted.

All of it is DataFrame work. Running sums come in two levels, so that a source with a third of all rows is spread:
sums by (source, bucket), offsets over those sums, then running sums inside each bucket. Buckets number about the
square root of the rows, so neither level has a large group.

Defined results: null text or one without words has size 0 and takes 0; a null source is a source of its own, last in
order; null or repeated doc_ids are rows of their own (equal rows differ at most in ``taken`` at a boundary); an empty
table gives an empty result. Columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, digits_key, numbered, table, words_of


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """One row per source (bounded by the number of sources): source, source_rank, weight, source_size, target.

    Weights 1, 2, 3 repeat over sources by code point, null last. Targets share the total by weight and stop at ``cap``
    times the source's size; the excess is reshared until none is above. In order of cap by weight, the capped
    sources are a prefix, so the water level is found with running sums instead of a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.row_number().over(by_name).alias("source_rank"))
    ranked = ranked.withColumn("weight", (F.col("source_rank") - 1) % 3 + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    lined = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    over = F.col("weight") * (F.col("total") - cap * F.col("size_before")).cast("double") > cap * F.col("source_size").cast("double") * F.col("weight_left")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = lined.withColumn("capped", F.min(over.cast("int")).over(upto) == 1)
    level = (F.first("total").over(everything) - cap * F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(everything)).cast("double")
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    return capped.select(
        "source", "source_rank", "weight", "source_size",
        F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level / left).alias("target"))


def _position(share, slope):
    """Where the integrated schedule t + slope * (t * t - t) reaches a share of the demand."""
    return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))


def mix(docs: DataFrame, cap: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the kept columns, source, size, source_size, target, taken, position (null where nothing is
    taken), and start, demand and slope, from which positions of further passes follow."""
    sized = cut(docs.select(
        "doc_id", *keep, "source", F.size(words_of(F.col("text"))).cast("long").alias("size"),
        digits_key(F.col("doc_id").cast("string")).alias("key")))
    n = sized.count()
    bits = max(0, math.ceil(math.log2(max(n, 1)) / 2))
    sources = source_targets(sized, cap)
    rows = sized.withColumn("bucket", F.shiftright("key", 60 - bits)).withColumnRenamed("source", "own_source").join(
        sources, F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    sums = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = sums.select(
        "source_rank", "bucket",
        (F.sum("bucket_size").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_size")).alias("bucket_offset"))
    running = Window.partitionBy("source_rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["source_rank", "bucket"]).withColumn("start", F.col("bucket_offset") + F.sum("size").over(running) - F.col("size"))
    demand = F.floor(F.col("target") + 0.5)
    passes = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - e * F.col("source_size") - F.col("start"))) for e in range(cap)]
    taken = passes[0]
    for one in passes[1:]:
        taken = taken + one
    slope = (F.col("weight") - 2) / F.lit(2.0)
    share = (F.col("start") + F.least(F.col("size"), F.col("taken")) / F.lit(2.0)) / F.col("demand")
    return placed.withColumn("taken", taken).withColumn("demand", demand.cast("double")).withColumn("slope", slope).withColumn(
        "share", F.when(F.col("taken") > 0, share)).select(
        "doc_id", *keep, "source", "size", "source_size", "target", "taken",
        _position(F.col("share"), F.col("slope")).alias("position"), "start", "demand", "slope")


def mixed_documents(docs: DataFrame, cap: int = 3) -> DataFrame:
    """``docs`` as the mix takes them, in training order: whole documents, as often as the taken words round to.

    At most one document a source is rounded; documents without words are not taken.
    """
    rows = numbered(docs)
    mixed = mix(rows.select("_doc.doc_id", "_doc.text", "_doc.source", "_row"), cap, ("_row",)).where("taken > 0").withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("copies > 0")
    passes = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), (F.col("start") + F.col("pass") * F.col("source_size") + F.col("size") / F.lit(2.0)) / F.col("demand"))
    placed = passes.select("_row", _position(share, F.col("slope")).alias("_position"))
    return rows.join(placed, "_row").orderBy("_position", "_row").select("_doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_sql(documents: str = "documents", cap: int = 3) -> str:
    """DuckDB SQL of :func:`mix`."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM {documents}),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sized GROUP BY source),
weighted AS (SELECT *, (source_rank - 1) % 3 + 1 AS weight FROM ranked),
lined AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER o, 0) AS size_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM weighted WINDOW o AS (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capping AS (
  SELECT *, min(CASE WHEN weight * (total - {cap} * size_before)::DOUBLE > {cap} * source_size::DOUBLE * weight_left::DOUBLE THEN 1 ELSE 0 END)
         OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS capped
  FROM lined),
targets AS (
  SELECT source, source_rank, weight, source_size,
         CASE WHEN capped THEN ({cap} * source_size)::DOUBLE
              ELSE weight * (total - {cap} * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())::DOUBLE
                   / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM capping),
placed AS (
  SELECT s.doc_id, s.size, t.*, floor(t.target + 0.5)::BIGINT AS demand, (t.weight - 2) / 2.0::DOUBLE AS slope,
         (sum(s.size) OVER (PARTITION BY t.source_rank ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, ({" + ".join(f"greatest(0, least(size, demand - {e} * source_size - start))" for e in range(cap))})::BIGINT AS taken FROM placed),
shared AS (
  SELECT *, CASE WHEN taken > 0 THEN (start + least(size, taken) / 2.0::DOUBLE) / demand::DOUBLE END AS share FROM mixed)
SELECT doc_id, size, source_size, target, taken,
       2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) AS position
FROM shared"""
