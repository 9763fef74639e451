"""Which modules yield symbols of the dictionary: a fixed point over re-exports, and the look-up of names in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import package_name
from sparkloom.operators.graph import closure
from sparkloom.scratch import cut, sorted_join
from sparkloom.sources.configs import resolve_modules


def kit_closure(imports: DataFrame, re_exports: DataFrame, files: DataFrame, kit_packages: DataFrame, upstream_scope: str | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """(source, kind, star, names, via): every module that yields symbols of the dictionary.

    Seeds are the packages of the dictionary that the project names ("package", all of whose names count) and packages
    of the scope it wraps ("wrapped-upstream", from which nothing spreads). A file that re-exports from a known source is
    one ("project-barrel"): with a star re-export all names count, else those it exports other than as types. What is
    known spreads semi-naively, each round joining only the files that the last one added; star flags and names follow
    in one aggregation, as whether a file is known does not depend on them. ``via``: the sources it has them from.
    """
    used = imports.select("file", "specifier").unionByName(re_exports.select("file", "specifier"))
    targets = resolve_modules(used, files, patterns or {}).where("target is not null").select("file", "specifier", "target")
    packages = used.select(package_name(F.col("specifier")).alias("source")).where("source is not null").distinct()
    known = kit_packages.select(F.col("package").alias("source")).distinct()
    seeds = packages.join(known, "source").select("source", F.lit("package").alias("kind"))
    if upstream_scope is not None:
        wrapped = packages.where(F.col("source").startswith(upstream_scope + "/")).join(known, "source", "left_anti")
        seeds = seeds.unionByName(wrapped.select("source", F.lit("wrapped-upstream").alias("kind")))
    links = cut(re_exports.join(sorted_join(targets), ["file", "specifier"]))
    edges = cut(links.select(F.col("target").alias("a"), F.col("file").alias("b")).distinct())
    reached = closure(seeds.where("kind = 'package'").select(F.col("source").alias("node"), F.lit("kit").alias("origin")), edges).select(F.col("node").alias("target")).distinct()
    given = links.join(sorted_join(reached), "target").select("file", "target", "star", F.transform(F.filter("names", lambda n: ~n["typeOnly"]), lambda n: n["exported"]).alias("exported"))
    barrels = given.groupBy("file").agg(
        F.bool_or("star").alias("star"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("star"), F.array().cast("array<string>")).otherwise(F.col("exported")))))).alias("names"),
        F.sort_array(F.collect_set("target")).alias("via"))
    none = F.array().cast("array<string>")
    return seeds.select("source", "kind", F.lit(True).alias("star"), none.alias("names"), F.array(F.when(F.col("kind") == "package", "declared kit package").otherwise("wrapped by the kit")).alias("via")).unionByName(
        barrels.select(F.col("file").alias("source"), F.lit("project-barrel").alias("kind"), "star", "names", "via"))


def kit_components(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """Bindings (with module and imported) and component: the imported name where its module yields it, else null.

    ``module`` is a resolved file or a package name; sources of the wrapped scope yield names of their own and count.
    """
    index = sources.select(F.col("source").alias("module"), "star", "names")
    hit = F.coalesce(F.col("star") | F.array_contains("names", F.col("imported")), F.lit(False))
    return bindings.join(index, "module", "left").withColumn("component", F.when(hit, F.col("imported"))).drop("star", "names")
