"""Scores of local components against a dictionary of components, from up to six parts of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.numbers import noisy_or

# Fixed values of the scores.
WEIGHTS = {"name": 0.7, "aria": 0.8, "props": 1.0, "tags": 0.6, "css": 0.3, "clone": 0.9}
GENERIC_ARIA = ["aria-label", "aria-labelledby", "aria-describedby", "aria-hidden", "aria-disabled", "aria-live"]
GENERIC_TAGS = [
    "div", "span", "p", "svg", "path", "g", "defs", "desc", "clipPath", "circle", "rect", "line", "ellipse", "polygon", "polyline", "animateTransform", "foreignObject"]
LEAST_NAME, MOST_EDITS, LEAST_PROPS, LEAST_CLONE = 4, 2, 2, 0.5
#: Thresholds of the verdicts.
CUSTOM, AMBIGUOUS, FORK, FORK_COVERAGE, FORK_PROPS = 0.6, 0.3, 0.6, 0.75, 3


def name_score(local: Column, name: Column, synonyms: Column) -> Column:
    """Equal names, then contained ones, then nearly equal ones; the dictionary's own name counts more than a synonym."""
    own = text.normalise_name(local)
    names = F.concat(F.array(name), synonyms)
    long = F.filter(names, lambda x: F.length(x) >= LEAST_NAME)
    contained = lambda x: own.contains(F.lower(x))
    close = F.exists(long, lambda x: F.levenshtein(own, F.lower(x)) <= MOST_EDITS) & (F.length(own) >= LEAST_NAME)
    return (
        F.when(text.normalise_name(name) == own, 1.0).when(F.exists(synonyms, lambda x: text.normalise_name(x) == own), 0.9)
        .when((F.length(name) >= LEAST_NAME) & contained(name), 0.75).when(F.exists(long, contained), 0.65).when(close, 0.55))


def same_name(local: Column, name: Column, synonyms: Column) -> Column:
    return F.exists(F.concat(F.array(name), synonyms), lambda x: text.normalise_name(x) == text.normalise_name(local))


def scores(locals_: DataFrame, signatures: DataFrame) -> DataFrame:
    """(name, component, score, parts, similarity, coverage, shared, same) of every pair that is not already a use.

    The dictionary is small by its nature and Spark broadcasts it under its size limit; every local meets all of it.
    """
    known = signatures.select(*(F.col(c).alias(f"k_{c}") for c in signatures.columns))
    pairs = locals_.join(known, ~F.array_contains(F.coalesce("kitComponentsUsed", F.array().cast("array<string>")), F.col("k_name")))
    generic = F.array(*map(F.lit, GENERIC_ARIA))
    tags = lambda c: F.array_distinct(F.filter(c, lambda x: ~x.isin(GENERIC_TAGS)))
    # each part is a column of its own, so that no expression is written out twice
    pairs = pairs.select(
        "name", F.col("k_name").alias("component"), "props", "k_propSignature", "k_propWeights", tags(F.col("nativeTags")).alias("_tags"), tags(F.col("k_nativeTags")).alias("_ktags"),
        name_score(F.col("name"), F.col("k_name"), F.col("k_synonyms")).alias("_name"), text.overlap(F.concat("ariaRoles", "ariaAttributes"), F.concat("k_ariaRoles", "k_ariaAttributes"), generic).alias("_aria"),
        text.jaccard(F.col("cssProperties"), F.col("k_cssProperties")).alias("_css"), text.sketch_similarity(F.col("sketch"), F.col("k_sketch")).alias("similarity"), same_name(F.col("name"), F.col("k_name"), F.col("k_synonyms")).alias("same"))
    pairs = pairs.select(
        "*", F.size(F.array_intersect("props", "k_propSignature")).alias("shared"), text.weighted_coverage(F.col("props"), F.col("k_propSignature"), F.col("k_propWeights")).alias("coverage"),
        text.weighted_jaccard(F.col("props"), F.col("k_propSignature"), F.col("k_propWeights"), LEAST_PROPS).alias("_props"),
        (text.jaccard(F.col("_tags"), F.col("_ktags")) * F.least(F.lit(1.0), F.size(F.array_intersect("_tags", "_ktags")) / 2)).alias("_both"))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    values = {"name": F.col("_name"), "aria": some("_aria"), "props": some("_props"), "tags": some("_both"), "css": some("_css"), "clone": F.when(F.col("similarity") >= LEAST_CLONE, F.col("similarity"))}
    return pairs.select(
        "name", "component", noisy_or(F.array(*((values[k] * F.lit(w)).cast("double") for k, w in WEIGHTS.items()))).alias("score"),
        F.map_filter(F.map_from_arrays(F.array(*map(F.lit, WEIGHTS)), F.array(*(values[k].cast("double") for k in WEIGHTS))), lambda k, v: v.isNotNull()).alias("parts"),
        "similarity", "coverage", "shared", "same")


def verdicts(locals_: DataFrame, signatures: DataFrame) -> DataFrame:
    """(name, verdict, component, confidence, best, candidates): fork, custom, ambiguous or none, one row per local.

    A fork has like code, or the same name and most of the dictionary component's own props; the likest code wins.
    """
    known = signatures.withColumn("sketch", text.minhash(F.col("astSignature"))).drop("astSignature")
    pairs = scores(locals_, known)
    by_code, by_name = F.col("similarity") >= FORK, F.col("same") & (F.col("coverage") >= FORK_COVERAGE) & (F.col("shared") >= FORK_PROPS)
    fork = F.struct((-F.when(by_code, F.col("similarity")).otherwise(F.lit(0.0))).alias("rank"), F.col("component"), F.when(by_code, F.col("similarity")).otherwise(F.col("coverage")).alias("likeness"))
    scored = F.struct((-F.col("score")).alias("rank"), F.col("component"))
    found = pairs.groupBy("name").agg(
        F.min(F.when(by_code | by_name, fork)).alias("fork"), F.max("score").alias("best"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("score") > 0, scored))), 1, 3).alias("top"))
    everyone = locals_.select("name").join(found, "name", "left")
    first = F.get("top", F.lit(0))
    best = F.coalesce("best", F.lit(0.0))
    verdict = F.when(F.col("fork").isNotNull(), "fork").when(best >= CUSTOM, "custom").when(best >= AMBIGUOUS, "ambiguous").otherwise("none")
    return everyone.select(
        "name", verdict.alias("verdict"), F.when(F.col("fork").isNotNull(), F.col("fork.component")).otherwise(first["component"]).alias("component"),
        F.when(F.col("fork").isNotNull(), F.least(F.lit(0.95), F.col("fork.likeness"))).when(best >= CUSTOM, F.least(F.lit(0.9), best)).otherwise(best).alias("confidence"),
        best.alias("best"), F.transform(F.coalesce("top", F.array().cast("array<struct<rank:double,component:string>>")), lambda x: x["component"]).alias("candidates"))


def novelty_rank(usages: Column, files: Column, copied: Column) -> Column:
    """Uses times the logarithm of the files, doubled for what is copied; two decimals."""
    raw = F.greatest(F.lit(1), usages) * F.log(F.greatest(F.lit(2), files + 1)) * F.when(copied, 2).otherwise(1)
    return F.floor(raw * 100 + 0.5) / 100
