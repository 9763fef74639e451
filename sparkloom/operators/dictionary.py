"""Builders of a dictionary from facts: exports, owners, dependencies, assets, icons, variants, themes, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import style, text
from sparkloom.functions.text import glob_pattern
from sparkloom.scratch import cut

#: How far star exports and variables are followed, and patterns of a component's assets.
STARS, VARIABLES = 8, 16
ASSETS = {"stories": r"\.stories\.[jt]sx?$", "docs": r"\.mdx?$", "tests": r"\.(test|spec)\.[jt]sx?$", "snapshots": r"\.snap$", "examples": r"(^|/)examples?/"}


def module_exports(local: DataFrame, re_exports: DataFrame) -> DataFrame:
    """(file, name, origin, rank): what each file exports, its own (2) before named (1) before star (0) re-exports.

    ``local`` has (file, name); ``re_exports`` has (file, target, name, as, star). Stars are followed through at most
    ``STARS`` files, and no file twice on one way.
    """
    named = re_exports.where("not star and target is not null").select("file", F.coalesce("as", "name").alias("name"), F.col("target").alias("origin"), F.lit(1).alias("rank"))
    direct = cut(local.select("file", "name", F.col("file").alias("origin"), F.lit(2).alias("rank")).unionByName(named).where("name is not null"))
    stars = re_exports.where("star and target is not null").select(F.col("file").alias("_from"), F.col("target").alias("_to")).distinct()
    ways = reached = cut(stars.select(F.col("_from").alias("file"), F.col("_to").alias("at"), F.array("_from", "_to").alias("way")))
    for _ in range(STARS - 1):
        step = ways.join(stars, F.col("at") == F.col("_from")).where(~F.array_contains("way", F.col("_to"))).select("file", F.col("_to").alias("at"), F.array_append("way", F.col("_to")).alias("way"))
        ways = cut(step)
        if ways.isEmpty():
            break
        reached = reached.unionByName(ways)
    # a star passes everything on but the default export
    passed = reached.select("file", "at").distinct().join(direct.select(F.col("file").alias("at"), "name", "origin"), "at").where("name <> 'default'").select("file", "name", "origin", F.lit(0).alias("rank"))
    every = direct.unionByName(passed)
    return every.groupBy("file", "name").agg(F.max(F.struct("rank", "origin")).alias("b")).select("file", "name", "b.origin", "b.rank")


def external_re_exports(re_exports: DataFrame) -> DataFrame:
    """Star exports of packages: each package with the sorted files that pass it on."""
    rows = re_exports.where("star and target is null").withColumn("package", text.package_name(F.col("specifier"))).where("package is not null")
    return rows.groupBy("package").agg(F.sort_array(F.collect_set("file")).alias("origins"))


def external_dependencies(imports: DataFrame, prefix: str | None = None) -> DataFrame:
    """(directory, package) of the packages that each directory imports; with a prefix, those it wraps."""
    rows = imports.select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("directory"), text.package_name(F.col("specifier")).alias("package")).where("package is not null")
    return (rows.where(F.col("package").startswith(prefix)) if prefix else rows).distinct()


def external_imports(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """Packages that are reached from entry files (file) over relative imports (file, specifier, target)."""
    from sparkloom.operators.graph import closure

    edges = imports.where("target is not null").select(F.col("file").alias("a"), F.col("target").alias("b")).distinct()
    seen = closure(entries.select(F.col("file").alias("node"), F.lit(0).alias("origin")), edges).select(F.col("node").alias("file")).distinct()
    return imports.join(seen, "file", "left_semi").select(text.package_name(F.col("specifier")).alias("package")).where("package is not null").distinct()


def public_directories(directories: DataFrame, barrel: DataFrame) -> DataFrame:
    """Directories with a flag: public if the barrel (target) re-exports something below."""
    shown = barrel.where("target is not null").select(F.regexp_extract("target", r"^(.*)/[^/]*$", 1).alias("directory")).distinct().withColumn("public", F.lit(True))
    return directories.join(shown, "directory", "left").withColumn("public", F.coalesce("public", F.lit(False)))


def public_symbols(lists: list[DataFrame], owners: DataFrame) -> DataFrame:
    """(name, origin, owner): the first of several export lists (name, origin) decides a name; owners are by file."""
    every = None
    for rank, one in enumerate(lists):
        rows = one.select("name", "origin", F.lit(rank).alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy("name").agg(F.min(F.struct("rank", "origin"))["origin"].alias("origin"))
    return first.join(owners.select(F.col("file").alias("origin"), "owner"), "origin", "left").select("name", "origin", "owner")


def recipe_variants(groups: DataFrame) -> DataFrame:
    """(name, prop, values): variant groups (file, name, prop, values array<string>) of all files as one, by name."""
    return groups.select("name", "prop", F.explode("values").alias("v")).groupBy("name", "prop").agg(F.sort_array(F.collect_set("v")).alias("values"))


def nested_counts(components: DataFrame) -> DataFrame:
    """One row of sums over nested lists: props, variants and their values, slots."""
    total = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).alias(c)
    values = F.aggregate(F.coalesce(F.map_values("variants"), F.array().cast("array<array<string>>")), F.lit(0), lambda n, x: n + F.size(x))
    return components.agg(F.count("*").alias("components"), total("props"), total("slots"), F.coalesce(F.sum(F.size(F.coalesce(F.map_keys("variants"), F.array().cast("array<string>")))), F.lit(0)).alias("variants"), F.coalesce(F.sum(values), F.lit(0)).alias("values"))


def assets(files: DataFrame) -> DataFrame:
    """(directory, kind, files): stories, docs, tests, snapshots and examples of each top directory."""
    kind = F.coalesce(*(F.when(F.col("file").rlike(p), k) for k, p in ASSETS.items()))
    rows = files.select(F.regexp_extract("file", "^([^/]+)/", 1).alias("directory"), kind.alias("kind"), "file").where("directory <> '' and kind is not null")
    return rows.groupBy("directory", "kind").agg(F.sort_array(F.collect_list("file")).alias("files"))


def icons(svg_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, size, fingerprint) of SVG files (file, content), and how many draw nothing that can be read.

    ``home-24.svg`` and ``24/home.svg`` are sizes of home; a file without one is of size 0.
    """
    base = F.regexp_extract("file", r"([^/]+)\.svg$", 1)
    folder = F.regexp_extract("file", r"(?:^|/)([0-9]+)(?:px)?/[^/]*$", 1)
    tail = F.regexp_extract(base, r"[-_]([0-9]+)(?:px)?$", 1)
    size = F.coalesce(F.when(tail != "", tail), F.when(folder != "", folder)).cast("int")
    rows = svg_files.select(F.regexp_replace(base, r"[-_][0-9]+(?:px)?$", "").alias("name"), F.coalesce(size, F.lit(0)).alias("size"), style.svg_fingerprint(F.col("content")).alias("fingerprint"))
    return rows.where("fingerprint is not null").distinct(), rows.agg(F.count_if(F.col("fingerprint").isNull()).alias("unreadable"))


def theme_values(variables: DataFrame) -> DataFrame:
    """(name, mode, value): light and dark values of variables (name, mode, value) with references to others filled in.

    Dark values stand over light ones; a chain is followed ``VARIABLES`` times, and what does not resolve stays as written.
    """
    light = variables.where("mode = 'light'").select("name", F.col("value").alias("l"))
    dark = variables.where("mode = 'dark'").select("name", F.col("value").alias("d"))
    both = light.join(dark, "name", "full").select("name", F.explode(F.create_map(F.lit("light"), F.coalesce("l", "d"), F.lit("dark"), F.coalesce("d", "l"))).alias("mode", "value"))
    known = cut(both)
    own = known.select(F.col("name").alias("_name"), F.col("mode").alias("_mode"), F.col("value").alias("_value"))
    now = known
    for _ in range(VARIABLES):
        inner = F.regexp_extract("value", r"var\((--[^),]+)\)", 1)
        step = now.withColumn("_ref", inner).join(own, (F.col("_ref") == F.col("_name")) & (F.col("mode") == F.col("_mode")), "left")
        filled = F.when(F.col("_value").isNotNull(), F.replace("value", F.concat(F.lit("var("), F.col("_ref"), F.lit(")")), F.col("_value"))).otherwise(F.col("value"))
        after = cut(step.select("name", "mode", filled.alias("value"), (filled != F.col("value")).alias("_moved")))
        now = after.drop("_moved")
        if not after.where("_moved").limit(1).count():
            break
    return now


def token_kind(path: Column, value: Column) -> Column:
    """Kind of a token by the words of its path, then by its value."""
    p, v = F.lower(path), F.lower(F.trim(value))
    by_path = F.when(p.contains("fontsize"), "fontSize").when(p.contains("lineheight"), "lineHeight").when(p.contains("fontweight"), "fontWeight").when(p.contains("fontfamily"), "fontFamily").when(p.contains("shadow"), "shadow")
    by_value = F.when(v.rlike(r"^(#[0-9a-f]{3,8}|rgba?\(.*\)|transparent)$"), "color").when(v.rlike(r"^-?[0-9.]+(px|rem|em)$"), "dimension").when(v.rlike(r"^-?[0-9.]+$"), "number")
    return F.coalesce(by_path, by_value, F.lit("other"))


def references(value: Column) -> Column:
    """Paths of the ``{tier.path}`` references of a value."""
    return F.regexp_extract_all(value, F.lit(r"\{([A-Za-z0-9_.-]+)\}"), F.lit(1))


def discover(files: DataFrame, exclude: list[str]) -> DataFrame:
    """Package directories (with a manifest) and their entry file, without those that a glob leaves out."""
    manifests = files.where(F.col("file").rlike(r"(^|/)package\.json$")).select(F.regexp_replace("file", r"/?package\.json$", "").alias("directory"))
    for glob in exclude:
        manifests = manifests.where(~F.col("directory").rlike(glob_pattern(glob)))
    entries = files.where(F.col("file").rlike(r"(^|/)(src/)?index\.[jt]sx?$")).select(F.regexp_replace("file", r"/?(src/)?index\.[jt]sx?$", "").alias("directory"), "file")
    first = entries.groupBy("directory").agg(F.min_by("file", F.struct(F.length("file"), "file")).alias("entry"))
    return manifests.join(first, "directory", "left")
