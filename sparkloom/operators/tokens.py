"""Tokens of a theme: nested trees to leaves, references resolved across tiers and modes, kinds, facets, scales, findings.

Trees come as rows (kit, tier, mode, file, tree), so that one run reads the themes of many kits; every step is keyed by
kit and path. Nothing of a whole theme meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import color, text
from sparkloom.operators.aggs import top_k_per_key
from sparkloom.scratch import cut, sorted_join

MODES = ["light", "dark"]
#: Levels of trees that are opened before what is left is written down.
LEVELS = 4
#: The names by which values refer to a tier, and the tiers that are published as variables of stylesheets.
TIERS = {"edsRef": "ref", "edsSys": "sys"}
PUBLISHED = ["ref", "sys"]

#: Kinds by words of the path, the first that fits; then keywords.
PATH_KINDS = [
    ("fontFamily", ["font", "family"]), ("fontFamily", ["font", "families"]), ("fontWeight", ["font", "weight"]), ("fontWeight", ["font", "weights"]),
    ("fontSize", ["font", "size"]), ("lineHeight", ["line", "height"]), ("lineHeight", ["line", "heights"]), ("letterSpacing", ["letter", "spacing"]),
    ("shadow", ["shadow"]), ("shadow", ["elevation"]), ("color", ["palette"]), ("color", ["color"])]
KEYWORDS = ["none", "inherit", "initial", "unset", "auto", "normal"]
TYPOGRAPHY = ["fontFamily", "fontWeight", "fontSize", "lineHeight", "letterSpacing"]

#: Words of component keys.
CATEGORY_WORDS = ["color", "shape", "typography", "width", "height", "size", "elevation", "opacity", "padding", "margin", "gap", "offset", "duration", "transition"]
STATE_WORDS = [
    "hover", "active", "focus", "disabled", "checked", "unchecked", "selected", "pressed", "visited", "indeterminate", "loading", "readonly", "empty", "expanded",
    "collapsed", "dragging"]
SIZE_WORDS = ["xxs", "xs", "sm", "md", "lg", "xl", "xxl"]
VIEW_WORDS = [
    "primary", "secondary", "tertiary", "accent", "contained", "outlined", "ghost", "filled", "clear", "error", "negative", "positive", "warning", "info", "success",
    "brand", "const"]

#: Groups of the ref tier whose values are scales, with what is read off; roots that would be a spacing scale.
SCALES = {
    "borderRadiusPx": ("borderRadius", "px"), "borderWidthPx": ("borderWidth", "px"), "fontSizePx": ("fontSize", "px"), "lineHeightPx": ("lineHeights", "px"),
    "fontWeights": ("fontWeights", "number"), "fontFamilies": ("fontFamilies", "string"), "letterSpacing": ("letterSpacing", "string")}
SPACING_ROOTS = ["spacing", "space", "padding", "margin", "gap", "size", "sizes"]
SAMPLES = 10


def leaves(trees: DataFrame) -> DataFrame:
    """(kit, tier, mode, file, path, value, type) of every leaf of the JSON trees, to any depth, ``LEVELS`` levels a pass.

    Items of lists have their place as a path segment; an empty object or list has no leaf; a null is a leaf of type
    ``null``. A tree that is null or no JSON gives no rows, and so does a bare value without a path. Of equal keys in
    one object the JSON reader's choice holds; other columns of ``trees`` are left out.
    """
    open_ = trees.select("kit", "tier", "mode", "file", F.array().cast("array<string>").alias("path"), F.try_parse_json("tree").alias("v")).where("v is not null")
    levels = []
    while True:
        for _ in range(LEVELS):
            # what is a leaf already, or empty, stays as it is
            open_ = trees.sparkSession.sql(
                "SELECT n.kit, n.tier, n.mode, n.file, IF(e.pos IS NULL, n.path, array_append(n.path, coalesce(e.key, CAST(e.pos AS STRING)))) AS path, IF(e.pos IS NULL, n.v, e.value) AS v "
                "FROM {nodes} n, LATERAL variant_explode_outer(n.v) e", nodes=open_)
        text_ = F.to_json("v")
        level = cut(open_.select("kit", "tier", "mode", "file", "path", text_.alias("v"), F.schema_of_variant("v").alias("shape")).where("size(path) > 0 AND v NOT IN ('{}', '[]')"))
        nested = F.col("shape").startswith("OBJECT") | F.col("shape").startswith("ARRAY")
        levels.append(level.where(~nested))
        if level.where(nested).isEmpty():
            break
        open_ = level.where(nested).select("kit", "tier", "mode", "file", "path", F.parse_json("v").alias("v"))
    rows = reduce(DataFrame.unionByName, levels)
    kind = F.when(F.col("shape") == "STRING", "string").when(F.col("shape") == "BOOLEAN", "boolean").when(F.col("shape") == "VOID", "null").otherwise("number")
    value = F.when(kind == "string", F.get_json_object(F.concat(F.lit("["), F.col("v"), F.lit("]")), "$[0]")).when(kind != "null", F.col("v"))
    return rows.select("kit", "tier", "mode", "file", "path", value.alias("value"), kind.alias("type"))


def authored(rows: DataFrame) -> DataFrame:
    """(kit, tier, path, value, type), one row a path, value and type by mode: a leaf without a mode is both, the later file
    (null first) wins, then the greater value; a path that one mode lacks has the other's value there."""
    pick = lambda m: F.max(F.when(F.col("mode").isNull() | (F.col("mode") == m), F.struct("file", "value", "type")))
    both = rows.groupBy("kit", "tier", "path").agg(pick("light").alias("l"), pick("dark").alias("d")).where("l is not null or d is not null")
    of = {"light": F.coalesce("l", "d"), "dark": F.coalesce("d", "l")}
    return both.select("kit", "tier", "path", *(F.struct(*(of[m][c].alias(m) for m in MODES)).alias(c) for c in ("value", "type")))


def references(value: Column) -> Column:
    """(raw, tier, path, alpha) of the ``{tier.path}`` references of a value, in order, each occurrence once.

    The alpha is that of ``rgba({tier.path}, alpha)``, and of all occurrences of that reference in the value; names that
    are no tier are no references.
    """
    raws = F.regexp_extract_all(value, F.lit(r"(\{[A-Za-z][A-Za-z0-9_$]*\.[^{}]+\})"), F.lit(1))
    wrapped = F.regexp_extract_all(value, F.lit(r"(rgba\(\s*\{[^{}]+\}\s*,\s*[0-9.]+\s*\))"), F.lit(1))
    alpha = lambda raw: F.try_element_at(
        F.filter(F.transform(F.filter(wrapped, lambda w: w.contains(raw)), lambda w: F.regexp_extract(w, r",\s*([0-9.]+)\s*\)$", 1).try_cast("double")), lambda a: a.isNotNull()), F.lit(-1))
    known = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))
    parts = F.transform(raws, lambda r: F.struct(
        r.alias("raw"), known[F.regexp_extract(r, r"^\{([^.]+)\.", 1)].alias("tier"), F.regexp_extract(r, r"^\{[^.]+\.(.*)\}$", 1).alias("path"),
        alpha(r).alias("alpha")))
    return F.coalesce(F.filter(parts, lambda p: p["tier"].isNotNull()), F.array().cast("array<struct<raw:string,tier:string,path:string,alpha:double>>"))


def resolved(values: DataFrame) -> DataFrame:
    """The rows of :func:`authored` with ``refs`` and ``resolved`` by mode: references replaced by what they resolve to.

    A reference is replaced once its target holds none that could still be replaced, so every round replaces one more
    tier of a chain and the rounds are as many as the longest chain. References to paths that do not exist, and those
    that come back to themselves, stay as written, and so does what refers to the latter.

    Values without references are met once, by the references to them; rounds move those with references alone, and
    those that wait for one another meet only what the last round settled.
    """
    per = lambda make: F.struct(*(make(m).alias(m) for m in MODES))
    rows = cut(values.withColumn("at", F.array_join("path", ".")).withColumn("refs", per(lambda m: references(F.col(f"value.{m}")))))
    many = lambda m: F.size(f"refs.{m}") > 0
    some = reduce(Column.__or__, map(many, MODES))
    key = ["kit", "mode", "tier", "at"]
    own = rows.where(some).select("kit", "tier", "path", "at", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"value.{m}").alias("value"), F.col(f"refs.{m}").alias("refs")) for m in MODES))).alias("x"))
    own = own.where("size(x.refs) > 0").select(*(F.col("x.mode") if c == "mode" else c for c in key), "path", "x.value", "x.refs")
    named = F.explode(F.array_distinct(F.transform("refs", lambda r: F.struct(r["raw"].alias("raw"), r["tier"].alias("to_tier"), r["path"].alias("to_at"))))).alias("r")
    edges = own.select(*key, named).select(*key, "r.*")
    # keys that hold a dot can give two paths one text, which no reference can tell apart: the smaller value counts
    there = rows.where(F.col("tier").isin(*TIERS.values())).groupBy(F.col("kit").alias("_kit"), F.col("tier").alias("_tier"), F.col("at").alias("_at")).agg(
        *(F.min(F.when(~many(m), F.col(f"value.{m}"))).alias(f"_{m}") for m in MODES), *(F.bool_or(many(m)).alias(f"_open_{m}") for m in MODES))
    by_mode = lambda stem: F.when(F.col("mode") == "light", F.col(f"{stem}light")).otherwise(F.col(f"{stem}dark"))
    live = edges.join(sorted_join(there), F.col("kit").eqNullSafe(F.col("_kit")) & (F.col("to_tier") == F.col("_tier")) & (F.col("to_at") == F.col("_at"))).select(
        *key, F.struct("raw", "to_tier", "to_at", by_mode("_").alias("text"), by_mode("_open_").alias("open")).alias("link"))
    links = live.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.array_sort(F.collect_set("link")).alias("links"))
    same = lambda: reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    state = cut(own.drop("refs").join(sorted_join(links), same(), "left").select(*key, "path", "value", "links"))
    waits = F.exists("links", lambda l: l["open"])
    swapped = F.aggregate(F.coalesce("links", F.array()), F.col("value"), lambda v, l: F.replace(v, l["raw"], F.coalesce(l["text"], F.lit("null"))))
    settled = lambda rows_: rows_.where(F.coalesce(~waits, F.lit(True))).select(*key, "path", swapped.alias("now"))
    finished, pending = [settled(state)], state.where(waits)
    while not pending.isEmpty():
        # one text a key; plain values of the same key are in the links
        fresh = finished[-1].where(F.col("tier").isin(*TIERS.values())).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("now").alias("_text"))
        asked = pending.select(*key, F.explode(F.filter("links", lambda l: l["open"])).alias("l"))
        met = asked.join(sorted_join(fresh), F.col("kit").eqNullSafe(F.col("_kit")) & (F.col("mode") == F.col("_mode")) & (F.col("l.to_tier") == F.col("_tier")) & (F.col("l.to_at") == F.col("_at"))).select(
            *key, "l.raw", F.least("l.text", "_text").alias("text"))
        given = met.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.map_from_entries(F.collect_set(F.struct("raw", "text"))).alias("_given"))
        filled = F.transform("links", lambda l: F.when(l["open"] & F.coalesce(F.map_contains_key("_given", l["raw"]), F.lit(False)), F.struct(
            l["raw"].alias("raw"), l["to_tier"].alias("to_tier"), l["to_at"].alias("to_at"), F.col("_given")[l["raw"]].alias("text"), F.lit(False).alias("open"))).otherwise(l))
        state = cut(pending.join(sorted_join(given), same(), "left").select(*key, "path", "value", filled.alias("links")))
        done = settled(state)
        if done.isEmpty():
            break
        finished.append(done)
        pending = state.where(waits)
    every = reduce(DataFrame.unionByName, finished).groupBy(F.col("kit").alias("_kit"), F.col("tier").alias("_tier"), F.col("path").alias("_path")).agg(
        *(F.max(F.when(F.col("mode") == m, F.col("now"))).alias(f"_{m}") for m in MODES))
    on = F.col("kit").eqNullSafe(F.col("_kit")) & F.col("tier").eqNullSafe(F.col("_tier")) & (F.col("path") == F.col("_path"))
    changed = rows.where(some).join(sorted_join(every), on, "left").select(*values.columns, "refs", per(lambda m: F.coalesce(f"_{m}", f"value.{m}")).alias("resolved"))
    return rows.where(~some).select(*values.columns, "refs", F.col("value").alias("resolved")).unionByName(changed)


def words(name: Column) -> Column:
    """Lower-case words of a name in camel case, with dashes, dots or underscores; digits are words of their own."""
    spaced = F.regexp_replace(name, r"[_\-\s.]+", " ")
    for pattern in ("([a-z])([A-Z])", "([A-Z]+)([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def value_kind(parts: Column, authored_: Column, resolved_: Column, type_: Column) -> Column:
    """Kind of a token by the words of its path (``parts``), then by the shape of what it resolves to."""
    by_path = [F.when(reduce(Column.__and__, (F.array_contains(parts, word) for word in need)), kind) for kind, need in PATH_KINDS]
    v = F.trim(F.coalesce(resolved_, authored_))
    by_value = (
        F.when((type_ == "null") | (type_ == "boolean") | v.isNull(), "unknown").when(v.rlike(r"\{(" + "|".join(TIERS) + r")\.[^{}]+\}"), "unknown").when(type_ == "number", "dimension")
        .when(F.lower(v).isin(KEYWORDS), "keyword").when(v.rlike(r"^(-?[0-9.]+px\s+){2,}"), "shadow").when(color.canonical_hex(v).isNotNull(), "color")
        .when(F.lower(v).rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)(px|rem|em|%|vh|vw|ch)?$"), "dimension").when(v.contains(","), "fontFamily").otherwise("unknown"))
    return F.coalesce(*by_path, by_value)


def category(kind: Column) -> Column:
    return F.when(kind.isin(TYPOGRAPHY), "typography").when(kind.isin("color", "shadow", "dimension"), kind).otherwise("other")


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once a row even where it is used many times."""
    return F.transform(F.array(value), body)[0]


def camel(items: Column) -> Column:
    """One camel-case name of a list of words; null if there are none."""
    name = F.array_join(F.transform(items, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), "")
    return F.when(F.size(items) > 0, name)


def facets(key: Column) -> Column:
    """(slot, category, modifiers, state, size, view) of a component's key: words before the first category word, that
    word, the words after it, and the run of states at the end."""
    first = lambda items, known: F.get(F.filter(items, lambda w: w.isin(known)), F.lit(0))

    def parts(all_: Column, at: Column, tail: Column, last: Column, modifiers: Column) -> Column:
        states = F.slice(tail, last + 1, F.greatest(F.size(tail) - last, F.lit(0)))
        return F.struct(
            F.when(at > 1, camel(F.slice(all_, F.lit(1), at - 1))).alias("slot"), F.when(at > 0, F.get(all_, at - 1)).alias("category"), modifiers.alias("modifiers"),
            camel(states).alias("state"), first(modifiers, SIZE_WORDS).alias("size"), first(modifiers, VIEW_WORDS).alias("view"))

    place = lambda all_: F.array_position(F.transform(all_, lambda w: w.isin(CATEGORY_WORDS)), True).cast("int")
    after = lambda all_, at: F.when(at > 0, F.slice(all_, at + 1, F.greatest(F.size(all_) - at, F.lit(0)))).otherwise(all_)
    end = lambda tail: F.coalesce(F.array_max(F.transform(tail, lambda w, i: F.when(~w.isin(STATE_WORDS), i + 1).otherwise(0))), F.lit(0)).cast("int")
    return let(words(key), lambda all_: let(place(all_), lambda at: let(after(all_, at), lambda tail: let(end(tail), lambda last: let(
        F.slice(tail, F.lit(1), last), lambda modifiers: parts(all_, at, tail, last, modifiers))))))


def shade_of(value: Column) -> Column:
    """Eight hex digits of a resolved colour; ``rgba(#rrggbb, alpha)``, a reference under an alpha, takes that alpha."""
    over = r"^rgba\(\s*(#[0-9A-Fa-f]{3,8})\s*,\s*([0-9.]+)\s*\)$"
    alpha = F.least(F.lit(1.0), F.regexp_extract(value, over, 2).try_cast("double"))
    laid = F.concat(F.substring(color.canonical_hex(F.regexp_extract(value, over, 1)), 1, 6), F.lpad(F.lower(F.hex(F.floor(alpha * 255 + 0.5).cast("long"))), 2, "0"))
    return F.coalesce(color.canonical_hex(value), laid)


def number_key(number: Column) -> Column:
    """A number as a text without needless decimals."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def extract_tokens(trees: DataFrame, prefix: str) -> DataFrame:
    """One row a token (kit, tier, path) with what is written and what it resolves to in both modes, its kind, colour,
    pixels, references, variable, component, facets and anomalies.

    The kind is that of the light mode. A value that reads NaN or Infinity once resolved is an anomaly. Trees of the
    same tier in several files are one tree; an empty table gives no tokens.
    """
    # words, kinds and shades are columns of their own, each made once a row
    rows = cut(resolved(authored(leaves(trees)))).withColumn("_words", F.flatten(F.transform("path", words)))
    kind = value_kind(F.col("_words"), F.col("value.light"), F.col("resolved.light"), F.col("type.light"))
    rows = rows.withColumn("kind", kind).withColumn("category", category(F.col("kind")))
    per = lambda make: F.struct(*(make(m).alias(m) for m in MODES))
    odd = F.exists(F.array(*(F.col(f"resolved.{m}") for m in MODES)), lambda v: F.coalesce(v.rlike("^-?(NaN|Infinity)$"), F.lit(False)))
    comp = F.col("tier") == "comp"
    return rows.select(
        "kit", F.concat_ws(".", "tier", F.array_join("path", ".")).alias("id"), "tier", "path", F.element_at("path", -1).alias("key"), "kind", "category", F.col("value").alias("authored"), "resolved",
        F.col("type.light").alias("type"), (~F.col("resolved.light").eqNullSafe(F.col("resolved.dark"))).alias("themeDependent"), F.col("refs").alias("references"),
        F.when(F.col("kind") == "color", per(lambda m: shade_of(F.col(f"resolved.{m}")))).alias("color"), per(lambda m: text.pixels(F.col(f"resolved.{m}"))).alias("px"),
        F.when(F.col("tier").isin(PUBLISHED), F.concat(F.lit(f"--{prefix}-"), F.array_join("path", "-"))).alias("cssVariable"), F.when(comp, F.get("path", F.lit(0))).alias("component"),
        F.when(comp, facets(F.element_at("path", -1))).alias("facets"), F.when(odd, F.array(F.lit("non-finite-number"))).otherwise(F.array().cast("array<string>")).alias("anomalies"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(kit, facet, value, n): tokens by tier, category and kind; different components, variables and theme-dependent ones."""
    one = lambda name, value: F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))
    each = F.array(one("total", F.lit("")), one("tier", F.col("tier")), one("category", F.col("category")), one("kind", F.col("kind")), one("cssVariables", F.when(F.col("cssVariable").isNotNull(), "")),
                   one("themeDependent", F.when(F.col("themeDependent"), "")))
    summed = tokens.select("kit", F.explode(each).alias("e")).where("e.value is not null").groupBy("kit", "e.facet", "e.value").agg(F.count("*").alias("n"))
    parts = tokens.where("component <> ''").select("kit", "component").distinct().groupBy("kit").agg(F.count("*").alias("n")).select("kit", F.lit("components").alias("facet"), F.lit("").alias("value"), "n")
    return summed.unionByName(parts)


def token_scales(tokens: DataFrame) -> DataFrame:
    """(kit, scale, step, number), one row a different value: scales of the ref tier in light mode, and all pixel values."""
    light, root = F.col("resolved.light"), F.get("path", F.lit(0))
    step = {"px": number_key(F.col("px.light")), "number": F.when(F.col("type") == "number", light), "string": F.when(F.col("type") == "string", light)}
    number = {"px": F.col("px.light"), "number": light.try_cast("double"), "string": F.lit(None).cast("double")}
    entry = lambda name, how, test: F.when(test & step[how].isNotNull(), F.struct(F.lit(name).alias("scale"), step[how].alias("step"), number[how].alias("number")))
    of_ref = [entry(name, how, (F.col("tier") == "ref") & (root == group)) for name, (group, how) in SCALES.items()]
    rows = tokens.select("kit", F.explode(F.array_compact(F.array(*of_ref, entry("allDimensionPx", "px", F.lit(True))))).alias("e"))
    return rows.select("kit", "e.*").distinct()


def token_lookup(tokens: DataFrame) -> DataFrame:
    """(kit, index, mode, key, id): tokens by colour, pixels and text of each mode, and the first token of each variable.

    One row an entry instead of a list a key, as a third of all tokens may share one value.
    """
    entry = lambda index, m, key: F.struct(F.lit(index).alias("index"), F.lit(m).alias("mode"), key.cast("string").alias("key"))
    each = [e for m in MODES for e in (entry("color", m, F.col("color")[m]), entry("dimensionPx", m, number_key(F.col("px")[m])), entry("literal", m, F.col("resolved")[m]))]
    values = tokens.select("kit", "id", F.explode(F.array(*each)).alias("e")).where("e.key is not null").select("kit", "e.*", "id").distinct()
    variables = tokens.where("cssVariable is not null").groupBy("kit", F.col("cssVariable").alias("key")).agg(F.min("id").alias("id"))
    return values.unionByName(variables.select("kit", F.lit("cssVariable").alias("index"), F.lit(None).cast("string").alias("mode"), "key", "id"))


def token_diagnostics(tokens: DataFrame) -> DataFrame:
    """(kit, code, severity, count, samples): what is wrong with the tokens themselves, with the first ten ids a code."""
    root = F.when(F.col("tier") == "ref", F.get("path", F.lit(0)))
    roots = tokens.select("kit", root.alias("root")).distinct()
    spaced = roots.groupBy(F.col("kit").alias("_kit")).agg(F.bool_or(F.coalesce(F.col("root").isin(SPACING_ROOTS), F.lit(False))).alias("_spaced")).where("not _spaced")
    bare = roots.join(spaced, F.col("kit").eqNullSafe(F.col("_kit")))
    found = [bare.select("kit", F.lit("spacing-scale-missing").alias("code"), F.lit("warning").alias("severity"), F.col("root").alias("sample"))]
    template = lambda m: F.coalesce(F.col(f"resolved.{m}").rlike(r"\{[^{}]+\}"), F.lit(False))
    tests = [
        ("reference-unresolved", "error", template("light") | template("dark")), ("value-non-finite", "error", F.array_contains("anomalies", "non-finite-number")),
        ("value-kind-unknown", "info", F.col("kind") == "unknown"),
        ("comp-token-literal", "warning", (F.col("tier") == "comp") & (F.size("references.light") == 0) & (F.col("type") == "string") & (F.col("category") != "other")),
        ("sys-color-theme-invariant", "info", (F.col("tier") == "sys") & (F.col("category") == "color") & ~F.col("themeDependent")),
        ("comp-key-unparsed", "info", (F.col("tier") == "comp") & F.col("facets.category").isNull())]
    flags = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in tests)))
    found.append(tokens.select("kit", F.explode(flags).alias("f"), "id").select("kit", "f.*", F.col("id").alias("sample")))
    shared = tokens.where("cssVariable is not null").groupBy("kit", "cssVariable").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1")
    found.append(shared.select("kit", F.lit("css-variable-collision").alias("code"), F.lit("error").alias("severity"), F.concat("cssVariable", F.lit(" <- "), "a", F.lit(", "), "b").alias("sample")))
    rows = cut(reduce(DataFrame.unionByName, found))
    counts = rows.groupBy("kit", "code", "severity").agg(F.count("sample").alias("count"))
    least = top_k_per_key(rows.where("sample is not null"), ["kit", "code"], [F.asc("sample")], SAMPLES).groupBy("kit", "code").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    on = counts["kit"].eqNullSafe(least["kit"]) & (counts["code"] == least["code"])
    return counts.join(least, on, "left").select(counts["kit"], counts["code"], "severity", "count", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
