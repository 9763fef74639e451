"""Class names: which element a style declaration ends up on, and which component a selector names.

Both are priority joins over exploded lists: of a declaration's classes the first that an element uses decides, of the
elements that use a class the first; of the classes in a selector the first that belongs to a component. Distinct class
lists and selectors are exploded, not rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.configs import resolve_modules

ACCESS = r"""([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*)|\[\s*["']([^"'\]]+)["']\s*\])"""
#: Pairs of an object literal: key, then an expression up to the comma outside round brackets.
PAIR = r"""["']?([\w$-]+)["']?\s*:\s*((?:[^,(){}]|\((?:[^()]|\([^()]*\))*\))+)"""
TARGET = "struct<kind:string,name:string,slot:string>"


def _accesses(expression: Column) -> Column:
    """array<struct<local, className>> of styles.a and styles['a'] in an expression, in order."""
    got = lambda i: F.regexp_extract_all(expression, F.lit(ACCESS), F.lit(i))
    return F.transform(F.arrays_zip(got(1).alias("a"), got(2).alias("b"), got(3).alias("c")), lambda x: F.struct(x["a"].alias("local"), F.when(x["b"] != "", x["b"]).otherwise(x["c"]).alias("className")))


def style_refs(elements: DataFrame, imports: DataFrame, files: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(module, className, file, ord, at, kind, name, slot): classes of stylesheet modules that elements use.

    They are read from className, and with their key as slot from classes={{key: ...}}. kind is kit, host or local;
    module is the stylesheet that the class's object was imported from, as its default or whole.
    """
    kind = F.when(F.col("kitComponent").isNotNull(), "kit").when(F.col("name").rlike("^[a-z]"), "host").otherwise("local")
    by_slot = F.col("propExpressions")["classes"]
    got = lambda i: F.regexp_extract_all(by_slot, F.lit(PAIR), F.lit(i))
    none = F.array().cast("array<struct<slot:string,expression:string>>")
    slots = F.coalesce(F.transform(F.arrays_zip(got(1).alias("a"), got(2).alias("b")), lambda x: F.struct(x["a"].alias("slot"), x["b"].alias("expression"))), none)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("slot"), F.col("propExpressions")["className"].alias("expression")))
    given = elements.select("file", "ord", kind.alias("kind"), F.coalesce("kitComponent", "name").alias("name"), F.posexplode(F.concat(whole, slots)).alias("part", "x")).where("x.expression is not null")
    used = given.select("file", "ord", "kind", "name", "part", "x.slot", F.posexplode(_accesses(F.col("x.expression"))).alias("nth", "y"))
    used = used.select("file", "ord", (F.col("part") * 1000 + F.col("nth")).alias("at"), "kind", "name", "slot", "y.local", "y.className")
    named = imports.where("defaultImport is not null").select("file", "specifier", F.col("defaultImport").alias("local"), F.col("ord").alias("_o"))
    modules = resolve_modules(named, files, patterns or {}).where("kind = 'file'").select("file", "specifier", F.col("target").alias("module"))
    bound = named.join(modules, ["file", "specifier"]).groupBy("file", "local").agg(F.min_by("module", "_o").alias("module"))
    return used.join(bound, ["file", "local"]).select("module", "className", "file", "ord", "at", "kind", "name", "slot")


def link_applied_to(style_values: DataFrame, refs: DataFrame) -> DataFrame:
    """Style values with appliedTo: the first of their classes that an element uses decides, and of those elements the first.

    Declarations with classes that no element uses are ``unused``; those without classes keep what they have.
    """
    target = F.struct("kind", "name", "slot")
    by_class = refs.groupBy(F.col("module").alias("file"), "className").agg(F.min_by(target, F.struct(F.col("file"), F.col("ord"), F.col("at"))).alias("to"))
    lists = style_values.where(F.size("classNames") > 0).select("file", "classNames").distinct()
    best = lists.select("file", "classNames", F.posexplode("classNames").alias("pos", "className")).join(by_class, ["file", "className"]).groupBy("file", "classNames").agg(F.min_by("to", "pos").alias("_to"))
    unused = F.struct(F.lit("unused").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("slot"))
    linked = F.when(F.size("classNames") > 0, F.coalesce("_to", unused).cast(TARGET)).otherwise(F.col("appliedTo"))
    return style_values.join(best, ["file", "classNames"], "left").select(*(linked.alias(c) if c == "appliedTo" else F.col(c) for c in style_values.columns))


def selector_targets(selectors: DataFrame, kit_classes: DataFrame, prefix: str) -> DataFrame:
    """(selector, component, slot, inner) of selectors that name a component's class: prefix-layer or prefix-layer-slot.

    The longest layer wins, then the first class of the selector. ``inner``: the selector goes on past the class, to
    something that the component renders.
    """
    whole = f"{re.escape(prefix)}-[A-Za-z0-9-]+"
    rows = selectors.select("selector").where(F.col("selector").contains(prefix + "-")).distinct()
    found, plain = F.regexp_extract_all("selector", F.lit(f"({whole})"), F.lit(1)), F.split("selector", whole, -1)
    each = rows.select("selector", found.alias("_m"), plain.alias("_p")).select("selector", "_m", "_p", F.posexplode("_m").alias("pos", "_class"))
    last = F.col("pos") + 1 == F.size("_m")
    tail = F.regexp_replace(F.get("_p", F.col("pos") + 1), r"""^["']?\s*\]""", "")
    tail = F.trim(F.when(last, F.regexp_replace(tail, "`$", "")).otherwise(tail))
    rest = F.substring("_class", len(prefix) + 2, 1 << 20)
    parts = F.split(rest, "-")
    each = each.select("selector", "pos", rest.alias("_rest"), (~tail.startswith(",") & ((tail != "") | ~last)).alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))).alias("layer"))
    hit = each.join(kit_classes.select("layer", "component").distinct(), "layer").groupBy("selector", "pos").agg(
        F.max_by(F.struct("component", F.nullif(F.expr("substring(_rest, length(layer) + 2)"), F.lit("")).alias("slot"), "inner"), F.length("layer")).alias("_t"))
    return hit.groupBy("selector").agg(F.min_by("_t", "pos").alias("_t")).select("selector", "_t.component", "_t.slot", "_t.inner")
