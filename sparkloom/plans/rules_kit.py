"""Rules that compare a project with a dictionary: dimensions, tiers, typography, keyboard patterns, icons, components, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import color, style, text
from sparkloom.operators import components, limits
from sparkloom.operators.classes import selector_targets
from sparkloom.operators.similarity import clusters
from sparkloom.plans.rules import Tables, finding, limits_of, rule, value_literals
from sparkloom.scratch import sorted_join, spread

# Fixed values of the rules.
FEWEST_LENGTHS, RARE, RARE_SHARE = 12, 2, 0.05
FEWEST_FIELDS = 3
KEYBOARD_ROLES = ["tablist", "menu", "menubar", "listbox", "tree", "grid", "radiogroup", "toolbar", "combobox", "slider", "spinbutton"]
SVG_LINES = 80
NOVEL_USAGES, NOVEL_FILES, COPIED = 3, 2, 0.8


def neighbours(scale: Column, value: Column) -> Column:
    """The largest value of a scale below and the smallest above, as far as there are any, joined by a comma."""
    below, above = F.array_max(F.filter(scale, lambda x: x < value)), F.array_min(F.filter(scale, lambda x: x > value))
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.nullif(F.concat_ws(",", short(below), short(above)), F.lit(""))


@rule("token.literal.dimension", "token", "style_values", "scales")
def literal_dimension(t: Tables) -> DataFrame:
    """Lengths written as numbers: on the property's scale, off it, or without a scale and then rare in the project or not."""
    judged = t.style_values.withColumn("_scale", F.when(F.col("source") == "ts-literal", "none").otherwise(style.dimension_scale(F.col("property")))).where("_scale is not null")
    literals = value_literals(judged, "dimension").withColumn("_l", F.col("raw")).withColumn("_px", text.pixels(F.col("_l"))).where("_px <> 0")
    ramps = t.scales.groupBy(F.col("scale").alias("_scale")).agg(F.sort_array(F.collect_set("px")).alias("_ramp"))
    named = t.scales.groupBy(F.col("scale").alias("_scale"), F.col("px").alias("_px")).agg(F.min("token").alias("_token"))
    on = literals.where("_scale <> 'none'").join(ramps, "_scale", "left").join(named, ["_scale", "_px"], "left").withColumn("_on", F.array_contains(F.coalesce("_ramp", F.array().cast("array<double>")), F.col("_px")))
    impact = F.concat_ws(":", "property", "_l")
    expected = F.when(F.col("_on"), F.col("_token")).otherwise(neighbours(F.col("_ramp"), F.col("_px")))
    scaled = finding(on, "token.literal.dimension", "token", F.when(F.col("_on"), "info").otherwise("warning"), 1.0, F.col("_l"), impact, F.when(F.col("_on"), "onScale").otherwise("offScale"), expected)
    free = literals.where("_scale = 'none'")
    counts = free.groupBy("_px").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    known = counts.join(total).withColumn("_rare", (F.col("_total") >= FEWEST_LENGTHS) & (F.col("_n") <= F.greatest(F.lit(RARE), F.floor(F.col("_total") * RARE_SHARE)))).select("_px", "_rare")
    rows = free.join(known, "_px")
    return scaled.unionByName(finding(rows, "token.literal.dimension", "token", F.when(F.col("_rare"), "warning").otherwise("info"), F.when(F.col("_rare"), 0.7).otherwise(0.5), F.col("_l"), impact, F.lit("noScale")))


@rule("token.tier.violation", "token", "style_values", "palette")
def tier_violation(t: Tables) -> DataFrame:
    """Variables of the primitive tier where a semantic one has the same colour (and the property's role, if it has one)."""
    used = value_literals(t.style_values, "var").select("file", "line", "column", "ord", F.col("raw").alias("_v"), style.color_role(F.col("property")).alias("_role"))
    primitive = t.palette.where("tier = 'primitive'").select(F.col("cssVariable").alias("_v"), color.canonical_hex(F.col("hex")).alias("_hex")).where("_hex is not null")
    semantic = t.palette.where("tier = 'semantic'").select("id", F.col("cssVariable").alias("_to"), "role", color.canonical_hex(F.col("hex")).alias("_hex"))
    best = F.min(F.struct("id", "_to"))
    by_role = semantic.groupBy("_hex", F.col("role").alias("_role")).agg(best.alias("_r"))
    any_role = semantic.groupBy("_hex").agg(best.alias("_a"))
    rows = used.join(primitive, "_v").join(by_role, ["_hex", "_role"], "left").join(any_role, "_hex", "left").withColumn(
        "_best", F.when(F.col("_role").isNull(), F.col("_a")).otherwise(F.col("_r"))).where("_best is not null")
    return finding(rows, "token.tier.violation", "token", "error", 1.0, F.col("_v"), F.col("_v"), None, F.col("_best._to"))


@rule("token.typography.partial", "typography", "style_values", "typography")
def partial_typography(t: Tables) -> DataFrame:
    """Blocks of three and more typographic fields that agree with a tuple in two at least, and differ in one at least."""
    fields = F.create_map(*(F.lit(x) for kv in style.TYPOGRAPHY.items() for x in kv))
    rows = t.style_values.where(F.col("property").isin(list(style.TYPOGRAPHY)) & ~F.col("value").contains("var(")).withColumn("_field", fields[F.col("property")])
    block = ["file", "_selector"]
    rows = rows.withColumn("_selector", F.coalesce("selector", F.lit("-")))
    large = rows.groupBy(*block).agg(F.count("*").alias("_n"), F.min(F.struct("line", "ord", "column")).alias("_at")).where(F.col("_n") >= FEWEST_FIELDS)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, "[\"']", "")))
    last = rows.groupBy(*block, "_field").agg(F.max(F.struct("ord", "value"))["value"].alias("_value")).join(large, block)
    tuples = t.typography.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("_field"), F.col(f).alias("_want")) for f in style.TYPOGRAPHY.values()))).alias("x")).select("id", "x.*").where("_want is not null")
    met = last.join(tuples, "_field").withColumn("_same", plain(F.col("_value")) == plain(F.col("_want")))
    differs = F.when(~F.col("_same"), F.concat_ws(" ", F.col("_field"), F.col("_value"), F.lit("for"), F.col("_want")))
    each = met.groupBy(*block, "_at", "id").agg(F.count_if("_same").alias("_matched"), F.array_join(F.sort_array(F.collect_list(differs)), "; ").alias("_differs"), F.count_if(~F.col("_same")).alias("_off"))
    best = each.groupBy(*block, "_at").agg(F.min(F.struct((-F.col("_matched")).alias("m"), "id", "_matched", "_differs", "_off")).alias("b"))
    families = t.typography.select(F.explode(style.font_families(F.col("fontFamily"))).alias("_family")).distinct()
    foreign = last.where("_field = 'fontFamily'").select(*block, F.explode(style.font_families(F.col("_value"))).alias("_family")).join(families, "_family", "left_anti").select(*block).distinct()
    size = last.groupBy(*block).agg(F.concat_ws("/", *(F.max(F.when(F.col("_field") == f, F.col("_value"))) for f in ("fontSize", "lineHeight", "fontWeight"))).alias("_actual"))
    found = best.where((F.col("b._off") > 0) & (F.col("b._matched") >= FEWEST_FIELDS - 1)).join(foreign, block, "left_anti").join(size, block)
    placed = found.select("file", F.col("_at.line").alias("line"), F.col("_at.column").alias("column"), F.col("_at.ord").alias("ord"), "b", "_actual")
    return finding(placed, "token.typography.partial", "typography", "warning", 0.8, F.col("_actual"), F.col("b.id"), None, F.col("b._differs"))


@rule("a11y.pattern.keyboard", "a11y", "elements", "patterns")
def pattern_keyboard(t: Tables) -> DataFrame:
    """Widgets of their own without keys, where the dictionary's component for the role handles some."""
    roles = t.patterns.select("component", "keysHandled", F.explode("roles").alias("_role")).groupBy("_role").agg(
        F.min(F.struct(F.length("component").alias("n"), "component", "keysHandled")).alias("_best"))
    widgets = t.elements.withColumn("_role", F.col("props")["role"]).where(F.col("_role").isin(KEYBOARD_ROLES) & F.col("kitComponent").isNull() & (F.size("keysHandled") == 0))
    rows = widgets.join(roles, "_role").where(F.size("_best.keysHandled") > 0).withColumn("_has", F.exists("eventHandlers", lambda x: x.startswith("onKey")))
    return finding(rows, "a11y.pattern.keyboard", "a11y", F.when(F.col("_has"), "warning").otherwise("error"), F.when(F.col("_has"), 0.5).otherwise(0.95), F.concat(F.lit('role="'), F.col("_role"), F.lit('"')),
                   F.col("_role"), F.when(F.col("_has"), "handlerUnreadable").otherwise("noHandler"), F.col("_best.component"))


@limits_of("a11y.pattern.keyboard", "elements")
def keyboard_unchecked(t: Tables) -> DataFrame:
    return limits.keyboard_limitations(t.elements, KEYBOARD_ROLES, t.patterns)


def icon_names(icons: DataFrame) -> DataFrame:
    """One icon a fingerprint: the first name, then the smallest size; the others are alternatives."""
    return icons.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("name", "size")).alias("_icon"), F.sort_array(F.collect_set("name")).alias("_names"))


def _icon_findings(rows: DataFrame, icons: DataFrame, id_: str, unread: Column) -> DataFrame:
    """Findings of rows with _print and _actual: the dictionary's icon, or a candidate for it."""
    met = rows.join(icon_names(icons), F.col("_print") == F.col("fingerprint"), "left")
    hit = F.col("_icon").isNotNull()
    return finding(met, id_, "icon", F.when(hit, "warning").otherwise("candidate"), F.when(hit, 0.95).otherwise(0.8), F.col("_actual"), F.coalesce("_icon.name", "_print", unread),
                   F.when(hit, "kit-icon").otherwise("no-match"), F.col("_icon.name"))


@rule("icon.inline-svg", "icon", "elements", "source_lines", "icons")
def inline_svg(t: Tables) -> DataFrame:
    """SVG elements; their markup is read from the lines after them."""
    svg = t.elements.where("name = 'svg'").select("file", "line", "column", "ord")
    lines = t.source_lines.select(F.col("file").alias("_file"), F.col("line").alias("_at"), "text")
    near = svg.join(lines, (F.col("file") == F.col("_file")) & F.col("_at").between(F.col("line"), F.col("line") + SVG_LINES - 1), "left")
    joined = near.groupBy("file", "line", "column", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    markup = F.regexp_extract("_text", r"(?s)(<svg.*?(?:</svg>|$))", 1)
    rows = joined.withColumn("_print", style.svg_fingerprint(markup)).withColumn("_actual", F.lit("<svg>"))
    return _icon_findings(rows, t.icons, "icon.inline-svg", F.concat_ws(":", "file", "line"))


@rule("icon.foreign-file", "icon", "imports", "style_values", "svg_files", "icons")
def foreign_svg_file(t: Tables) -> DataFrame:
    """SVG files that imports and url(...) name, relative to the file."""
    imported = t.imports.where(F.col("specifier").rlike(r"\.svg([?#]|$)")).select("file", "line", "column", "ord", F.col("specifier").alias("_actual"))
    urls = F.regexp_extract_all("value", F.lit(r"url\(\s*[\"']?([^\"')]+\.svg(?:[?#][^\"')]*)?)[\"']?\s*\)"), F.lit(1))
    styled = t.style_values.select("file", "line", "column", "ord", F.explode(urls).alias("_actual"))
    used = imported.unionByName(styled).withColumn("_path", text.resolve_reference(F.col("file"), F.col("_actual")))
    drawn = t.svg_files.select(F.col("file").alias("_path"), style.svg_fingerprint(F.col("content")).alias("_print"))
    return _icon_findings(used.join(drawn, "_path", "left"), t.icons, "icon.foreign-file", F.col("_actual"))


def local_components(t: Tables) -> DataFrame:
    """The first declaration of each capitalised component that renders something, with its uses, their files and its sketch."""
    used = t.elements.where(F.col("kitComponent").isNull() & F.col("name").rlike("^[A-Z]")).groupBy("name").agg(F.count("*").alias("usages"), F.countDistinct("file").alias("files"))
    own = t.declarations.where((F.col("kind") == "component") & F.col("name").rlike("^[A-Z]") & (F.col("elementCount") > 0)).drop("usages", "files")
    rest = [c for c in own.columns if c != "name"]
    first = own.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("ord", "file", "line")).alias("d")).select("name", "d.*")
    return spread(first, "name").join(sorted_join(used), "name", "left").withColumn("usages", F.coalesce("usages", F.lit(0))).withColumn("files", F.coalesce("files", F.lit(0))).withColumn("sketch", text.minhash(F.col("astSignature")))


@rule("component.duplicate", "component", "declarations", "elements")
def component_duplicate(t: Tables) -> DataFrame:
    """Clusters of components with alike signatures; the anchor is the most used, then in the most files, then by name."""
    own = local_components(t)
    found = clusters(own.select("name", "sketch"), "name", COPIED)
    order = F.struct(-F.col("usages"), -F.col("files"), F.col("name"))
    best = found.join(sorted_join(own.drop("sketch")), "name").groupBy("anchor", "members").agg(F.min_by(F.struct("name", "file", "line", "column", "ord"), order).alias("b")).select("members", "b.*")
    return finding(best, "component.duplicate", "component", "candidate", 0.9, F.col("name"), F.col("name"), None, F.col("members").cast("string"))


def _component_rule(verdict: str, severity: str):
    id_ = f"component.{verdict}"

    @rule(id_, "component", "declarations", "elements", "signatures")
    def run(t: Tables) -> DataFrame:
        own = local_components(t)
        rows = components.verdicts(own, t.signatures).where(F.col("verdict") == verdict).join(own.select("name", "file", "line", "column", "ord"), "name")
        return finding(rows, id_, "component", severity, F.col("confidence"), F.col("name"), F.col("name"), None, F.when(F.lit(verdict != "ambiguous"), F.col("component")))

    return run


component_fork = _component_rule("fork", "warning")
component_custom = _component_rule("custom", "warning")
component_ambiguous = _component_rule("ambiguous", "info")


@rule("component.novel", "component", "declarations", "elements", "signatures")
def component_novel(t: Tables) -> DataFrame:
    """Components like none of the dictionary that the project uses in several files, or has copies of."""
    own = local_components(t)
    copied = clusters(own.select("name", "sketch"), "name", COPIED).select("name", F.lit(True).alias("_copied"))
    rows = components.verdicts(own, t.signatures).where(F.col("best") < components.AMBIGUOUS).select("name").join(own, "name").join(copied, "name", "left").withColumn("_copied", F.coalesce("_copied", F.lit(False)))
    rows = rows.where(F.col("_copied") | ((F.col("usages") >= NOVEL_USAGES) & (F.col("files") >= NOVEL_FILES)))
    rank = components.novelty_rank(F.col("usages"), F.col("files"), F.col("_copied")).cast("string")
    return finding(rows, "component.novel", "component", "candidate", 0.8, F.col("name"), F.col("name"), None, rank)


#: Box sizes, which count as size where the selector names the component.
BOX_SIZES = ["width", "min-width", "max-width", "inline-size", "min-inline-size", "max-inline-size", "block-size"]


def overrides(t: Tables) -> DataFrame:
    """Declarations on a component, one row for each file, selector and verdict: important, inner, repaint or size.

    The component is the one that the declaration's class was linked to; else, with classes of the dictionary, the first
    that the selector names, and then a declaration can have several verdicts.
    """
    rows = t.style_values.withColumn("_linked", F.coalesce((F.col("appliedTo.kind") == "kit") & F.col("appliedTo.name").isNotNull(), F.lit(False)))
    if t.slots is not None:
        parts = t.slots.where("inner").select(F.col("component").alias("_c"), F.col("slot").alias("_s"), F.lit(True).alias("_inner")).distinct()
        rows = rows.join(parts, (F.col("appliedTo.name") == F.col("_c")) & (F.col("appliedTo.slot") == F.col("_s")), "left")
    else:
        rows = rows.withColumn("_inner", F.lit(None).cast("boolean"))
    if t.kit_classes is not None and t.class_prefix:
        named = selector_targets(t.style_values, t.kit_classes, t.class_prefix).select("selector", F.struct("component", "slot", "inner").alias("_named"))
        rows = rows.join(named, "selector", "left")
    else:
        rows = rows.withColumn("_named", F.lit(None).cast("struct<component:string,slot:string,inner:boolean>"))
    important, category = style.is_important(F.col("important"), F.col("value")), style.style_category(F.col("property"))
    one = F.when(F.coalesce("_inner", F.lit(False)), "inner").when(important, "important").when(category != "layout", category)
    graded = F.when((category == "layout") & F.lower("property").isin(BOX_SIZES), "size").when(category != "layout", category)
    several = F.array(F.when(important, "important"), F.when(F.col("_named.inner"), "inner"), graded)
    verdicts = F.when(F.col("_linked"), F.array(one)).when(F.col("_named").isNotNull(), several)
    target = F.when(F.col("_linked"), F.col("appliedTo")).otherwise(F.struct(F.lit("kit").alias("kind"), F.col("_named.component").alias("name"), F.col("_named.slot").alias("slot")))
    judged = rows.withColumn("_to", target).withColumn("_verdict", F.explode(verdicts)).where("_verdict is not null")
    first = F.min(F.struct("ord", "line", "column", "property", "value", F.col("_to").alias("appliedTo")))
    found = judged.groupBy("file", F.coalesce("selector", "property").alias("_selector"), "_verdict").agg(first.alias("f"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "property"))), lambda x: x["property"]), ", ").alias("_properties"))
    return found.select("file", "_verdict", "_properties", "f.*")


def _override_rule(verdict: str, severity: str, confidence: float):
    id_ = f"style.override.{verdict}"

    @rule(id_, "override", "style_values")
    def run(t: Tables) -> DataFrame:
        name = F.concat_ws(".", "appliedTo.name", "appliedTo.slot") if verdict == "inner" else F.col("appliedTo.name")
        return finding(overrides(t).where(F.col("_verdict") == verdict), id_, "override", severity, confidence, F.concat_ws(": ", "property", "value"), name, None, F.col("_properties"))

    return run


override_important = _override_rule("important", "error", 1.0)
override_inner = _override_rule("inner", "error", 1.0)
override_repaint = _override_rule("repaint", "warning", 0.9)
override_size = _override_rule("size", "info", 0.7)
