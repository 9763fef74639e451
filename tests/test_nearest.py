"""Nearest strings and points against all pairs, at a dictionary of 100,000 rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import nearest


def test_strings_against_all_pairs(spark):
    rng = random.Random(4)
    some = lambda n, k: sorted({"".join(rng.choices("abé", k=rng.randint(0, k))) for _ in range(n)})
    words, entries = some(120, 7), some(150, 7)
    w, e = spark.createDataFrame([(x,) for x in [*words, None, words[0]]], "w string"), spark.createDataFrame([(x,) for x in [*entries, None]], "e string")
    got = {(r.word, r.entry): r.distance for r in nearest.similar_strings(w, "w", e, "e").collect()}
    pairs = w.distinct().join(e, F.lit(True)).select("w", "e", F.levenshtein("w", "e").alias("d")).where("d <= 2")
    assert got == {(r.w, r.e): r.d for r in pairs.collect()} and len(got) > 500


def test_suggestions(spark):
    w = spark.createDataFrame([("buton",), ("li",), ("xyz",), ("lst",), ("dialgo",), (None,), ("",)], "w string")
    e = spark.createDataFrame([("button",), ("list",), ("last",), ("link",), ("dialog",)], "e string")
    assert {(r.word, r.suggestion) for r in nearest.suggestions(w, "w", e, "e").collect()} == {("buton", "button"), ("dialgo", "dialog")}


def test_points_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    tokens, own = rng.random((100_000, 3)) * [1, 0.3, 0.3], np.vstack([rng.random((60, 3)), [[3.0, 0.1, 0.1], [0.5, -0.9, 0.2], [9, 9, 9]]])
    t = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(tokens)], "t int, a double, b double, c double")
    r = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(own)], "k int, x double, y double, z double")
    mine, theirs = [F.col(c) for c in "xyz"], [F.col(c) for c in "abc"]
    d = F.round(F.sqrt(sum((p - q) * (p - q) for p, q in zip(mine, theirs, strict=True))), 5)
    found = {x.k: (x.t, x.distance) for x in nearest.nearest_point(r, t, mine, theirs, d, ["k"], ["t"], ["t"], 0.05, rings=7).collect()}
    want = {}
    for i, x in enumerate(own):
        all_ = np.round(np.sqrt(((tokens - x) ** 2).sum(axis=1)), 5)
        if all_.min() < 0.05 * 2**6:
            want[i] = (int(all_.argmin()), float(all_.min()))
    assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in want.items()} and found == want and set(found) == set(range(62))


def test_pairs_of_a_dense_palette(spark):
    """A row meets the candidates near it, however many the widest ring holds."""
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.random((20_000, 3)))], "t int, a double, b double, c double")
    other = [F.col(c) for c in "abc"]
    halvings = nearest._halvings(t, other, 0.1)
    r = t.select(F.col("t").alias("k"), *(F.col(c).alias(d) for c, d in zip("abc", "xyz", strict=True)))
    pairs = nearest.pairs_within(r, t, [F.col(c) for c in "xyz"], other, 0.1 / 2**halvings)
    assert halvings > 0 and pairs.count() < 150 * 20_000
