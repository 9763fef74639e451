"""Nearest neighbours without all pairs: strings by deletion neighbourhoods, points by a grid with rings.

Both turn nearness into equi-joins that find every pair within the distance asked for, and verify the pairs they find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import cut, sorted_join

#: Cells are wider than their radius by this factor; candidates a cell to start with; halvings of a radius.
SLACK, CROWD, FINEST = 1.02, 4, 8


def _deletions(text: Column, most: int) -> Column:
    """All strings that at most ``most`` deletions make of a text, itself included."""
    def one(t: Column) -> Column:
        return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))

    level = known = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        known = F.array_distinct(F.concat(known, level))
    return known


def similar_strings(words: DataFrame, word: str, dictionary: DataFrame, entry: str, most: int = 2) -> DataFrame:
    """(word, entry, distance) of all pairs within ``most`` edits. Two strings that are so near share a deletion neighbour.

    Distinct words and entries are exploded, to about length ** most rows each. Nulls are near nothing.
    """
    left = words.select(F.col(word).alias("word")).where("word is not null").distinct().select("word", F.explode(_deletions(F.col("word"), most)).alias("_near"))
    right = dictionary.select(F.col(entry).alias("entry")).where("entry is not null").distinct().select("entry", F.explode(_deletions(F.col("entry"), most)).alias("_near"))
    pairs = left.join(right, "_near").select("word", "entry").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "entry")).where(F.col("distance") <= most)


def suggestions(words: DataFrame, word: str, dictionary: DataFrame, entry: str) -> DataFrame:
    """(word, suggestion): the nearest entry within a third of the word's length, at least one edit and at most two; ties
    suggest nothing."""
    most = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.length("word") / 3)))
    near = similar_strings(words, word, dictionary, entry).where(F.col("distance") <= most)
    best = near.groupBy("word", "distance").agg(F.min("entry").alias("suggestion"), F.count("*").alias("n")).groupBy("word").agg(F.min(F.struct("distance", "suggestion", "n")).alias("b"))
    return best.where("b.n = 1").select("word", F.col("b.suggestion").alias("suggestion"))


def _cells(point: Sequence[Column], size: float) -> list[Column]:
    return [F.floor(x / size).cast("long") for x in point]


def pairs_within(rows: DataFrame, candidates: DataFrame, point: Sequence[Column], other: Sequence[Column], radius: float) -> DataFrame:
    """Rows joined to the candidates in their own and all adjoining grid cells, among them every one within ``radius``.

    Cells are a little wider than the radius, so that rounded distances do not fall outside. The candidates are copied
    into the cells around theirs; rows, of which there are more, stay one each.
    """
    size = radius * SLACK
    around = lambda x: F.array(x - 1, x, x + 1)
    left = rows
    for i, x in enumerate(_cells(point, size)):
        left = left.withColumn(f"_c{i}", x)
    right = candidates
    for i, x in enumerate(_cells(other, size)):
        right = right.withColumn(f"_c{i}", F.explode(around(x)))
    names = [f"_c{i}" for i in range(len(point))]
    return left.join(sorted_join(right), names).drop(*names)


def _halvings(candidates: DataFrame, other: Sequence[Column], radius: float) -> int:
    """How often to halve ``radius`` until a candidate shares its cell with few others, at most FINEST times."""
    level = F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("_k")
    cells = candidates.select(*(x.alias(f"_x{i}") for i, x in enumerate(other)), level).select("_k", *(F.floor(F.col(f"_x{i}") * F.pow(F.lit(2.0), F.col("_k")) / (radius * SLACK)).alias(f"_c{i}") for i in range(len(other))))
    counts = cells.groupBy(*cells.columns).agg(F.count("*").cast("double").alias("n"))
    crowd = counts.groupBy("_k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"))  # one row a level
    return crowd.agg(F.coalesce(F.min(F.when(F.col("crowd") <= CROWD, F.col("_k"))), F.lit(FINEST))).first()[0]


def nearest_point(rows: DataFrame, candidates: DataFrame, point: Sequence[Column], other: Sequence[Column], distance: Column, key: list[str], tie: list[str], take: list[str], radius: float, rings: int = 5) -> DataFrame:
    """Each key with its nearest candidate and the distance, as joins.nearest gives them, ring by ring.

    A key is settled in the first ring that holds a candidate; the next ring is twice as wide, and what is still open
    after the last ring, ``radius`` doubled ``rings`` - 1 times, has none. A ring meets only the keys that are open. Where
    candidates are many the first rings are narrower than ``radius``, so that pairs grow with the rows, not with both sides.
    """
    open_, candidates, found = cut(rows), cut(candidates), None  # coordinates are worked out once, not in every use
    for k in range(-_halvings(candidates, other, radius), rings):
        wide = radius * 2**k
        pairs = pairs_within(open_, candidates, point, other, wide).withColumn("_d", distance).where(F.col("_d") < wide)
        best = cut(pairs.groupBy(*key).agg(F.min(F.struct("_d", *tie, *[c for c in take if c not in tie])).alias("_b")).select(*key, *(F.col(f"_b.{c}").alias(c) for c in take), F.col("_b._d").alias("distance")))
        found = best if found is None else found.unionByName(best)
        open_ = open_.join(sorted_join(best.select(*key)), key, "left_anti")
        if k + 1 < rings:
            open_ = cut(open_)
            if open_.isEmpty():
                break
    return found
