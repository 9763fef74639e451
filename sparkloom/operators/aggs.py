"""Roll-ups of findings: counts, impact, problems, shares, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numbers import all_of


def zero_filled(rows: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Count per key: known keys always, unknown ones if they occur."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    dimension = rows.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
    return dimension.join(counts, key, "full").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def impact(rows: DataFrame, key: str, file: str) -> DataFrame:
    """Every row with the rows and the distinct files of its key. The roll-up has one row a key and is joined back."""
    sums = rows.groupBy(key).agg(F.count("*").alias("occurrences"), F.countDistinct(file).alias("files"))
    return rows.join(sums, key)


def facet_counts(rows: DataFrame, facets: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each facet, counts of its values over rows that pass all other facets' filters; one branch a facet."""
    branches = []
    for name, (column, _) in facets.items():
        others = all_of([test for other, (_, test) in facets.items() if other != name])
        branches.append(rows.where(others).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n"))
    return reduce(DataFrame.unionByName, branches)


def largest_remainder(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Whole percentages that add up to 100: floors, then one more for the largest remainders, ties by key."""
    everything = Window.partitionBy()
    share = counts.withColumn("_x", F.col(n) * 100.0 / F.sum(n).over(everything)).withColumn("_f", F.floor("_x").cast("long"))
    ranked = share.withColumn("_r", F.row_number().over(Window.orderBy((F.col("_x") - F.col("_f")).desc(), key)))
    return ranked.select(key, n, (F.col("_f") + F.when(F.col("_r") <= 100 - F.sum("_f").over(everything), 1).otherwise(0)).cast("long").alias("percent"))


def mode_per_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def top_k_per_key(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def global_number(rows: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """1-based number after a total sort, without one task for all rows: a range sort, places inside the partitions and
    one small table of partition sizes."""
    from sparkloom.scratch import cut

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return ordered.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_part")).withColumn(number, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def idf(rows: DataFrame, document: str, term: str) -> DataFrame:
    """term, documents and round(ln(N / documents), 3); N is every document of the input."""
    n = rows.select(document).distinct().count()
    return rows.select(document, term).distinct().groupBy(term).agg(F.count("*").alias("df")).withColumn("idf", F.floor(F.log(F.lit(float(n)) / F.col("df")) * 1000 + 0.5) / 1000)
