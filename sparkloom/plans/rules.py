"""Rules as DataFrame plans: (Tables) -> findings, a registry, and the run with impact, order and numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions import color, edits, style, text, values
from sparkloom.functions.numbers import any_of, round_half_up
from sparkloom.operators import limits
from sparkloom.operators.aggs import global_number
from sparkloom.operators.joins import asof_backward
from sparkloom.operators.nearest import pairs_within
from sparkloom.schemas import FINDING, FINDING_ROW
from sparkloom.scratch import cut, sorted_join


@dataclass
class Tables:
    style_values: DataFrame | None = None
    elements: DataFrame | None = None
    imports: DataFrame | None = None
    declarations: DataFrame | None = None
    lint_messages: DataFrame | None = None
    tokens: DataFrame | None = None  # id, hex, and perhaps tier and role
    symbols: DataFrame | None = None  # name, note (deprecated ones)
    variants: DataFrame | None = None  # component, prop, legal array<string>
    kit_packages: DataFrame | None = None  # package, exports array<string>
    upstream: DataFrame | None = None  # package, wrapper
    palette: DataFrame | None = None  # id, cssVariable, tier (primitive or semantic), hex, role
    scales: DataFrame | None = None  # scale, px double, token
    typography: DataFrame | None = None  # id, fontFamily, fontSize, fontWeight, lineHeight, letterSpacing
    patterns: DataFrame | None = None  # component, roles array<string>, keysHandled array<string>
    icons: DataFrame | None = None  # name, size, fingerprint
    source_lines: DataFrame | None = None  # file, line, text
    svg_files: DataFrame | None = None  # file, content string
    signatures: DataFrame | None = None  # name, synonyms, propSignature, propWeights, ariaRoles, ariaAttributes, nativeTags, cssProperties, astSignature
    slots: DataFrame | None = None  # component, slot, inner; without it no part counts as inner
    kit_classes: DataFrame | None = None  # layer, component: classes are class_prefix-layer or class_prefix-layer-slot
    class_prefix: str | None = None


@dataclass
class Rule:
    id: str
    category: str
    needs: tuple[str, ...]
    run: Callable[[Tables], DataFrame]


@dataclass
class Limits:
    """What a rule could not check: the tables that are needed to say so, and (Tables) -> limitations."""

    needs: tuple[str, ...]
    run: Callable[[Tables], DataFrame]


REGISTRY: dict[str, Rule] = {}
LIMITS: dict[str, Limits] = {}


def rule(id_: str, category: str, *needs: str):
    def register(f):
        REGISTRY[id_] = Rule(id_, category, needs, f)
        return f

    return register


def limits_of(id_: str, *needs: str):
    """Registers the second output of a rule: rows that it met and could not check."""
    def register(f):
        LIMITS[id_] = Limits(needs, f)
        return f

    return register


def finding(rows: DataFrame, id_: str, category: str, severity: Column | str, confidence: Column | float, actual: Column, impact: Column | None = None, subkind: Column | None = None, expected: Column | None = None) -> DataFrame:
    """Rows with file, line, column and ord in the shape of findings; impactKey is the rule, then the impact."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    key = F.lit(id_) if impact is None else F.concat(F.lit(id_ + ":"), impact)
    values = [F.lit(id_), none if subkind is None else subkind, F.lit(category), lit(severity), lit(confidence).cast("double"), F.col("file"), F.col("line"), F.col("column"), F.col("ord"),
              actual, none if expected is None else expected, key]
    return rows.select(*(v.alias(n) for v, n in zip(values, FINDING, strict=True)))


# Fixed values of the rules.
ICON_PACKAGES = ["react-icons", "@mui/icons-material", "@material-ui/icons", "lucide-react", "@tabler/icons", "@heroicons/react", "@ant-design/icons", "react-feather", "@phosphor-icons/react", "@radix-ui/react-icons"]
IMPLICIT_ROLES = {
    "button": "button", "a": "link", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "ul": "list", "ol": "list",
    "li": "listitem", "table": "table", "form": "form", "dialog": "dialog", "img": "img", "textarea": "textbox", "select": "combobox", "progress": "progressbar"}
REQUIRED_ATTRIBUTES = {
    "checkbox": ["aria-checked"], "combobox": ["aria-controls", "aria-expanded"], "heading": ["aria-level"], "meter": ["aria-valuenow"], "menuitemcheckbox": ["aria-checked"], "menuitemradio": ["aria-checked"],
    "option": ["aria-selected"], "radio": ["aria-checked"], "scrollbar": ["aria-controls", "aria-valuenow"], "slider": ["aria-valuenow"], "switch": ["aria-checked"]}
ABSTRACT_ROLES = [
    "command", "composite", "input", "landmark", "range", "roletype", "section", "sectionhead", "select", "structure", "widget", "window",
]
ROLES = [
    "alert", "alertdialog", "application", "article", "banner", "blockquote", "button", "caption", "cell", "checkbox", "code", "columnheader", "combobox", "complementary", "contentinfo",
    "definition", "deletion", "dialog", "directory", "document", "emphasis", "feed", "figure", "form", "generic", "grid", "gridcell", "group", "heading", "img", "insertion", "link", "list",
    "listbox", "listitem", "log", "main", "mark", "marquee", "math", "menu", "menubar", "menuitem", "menuitemcheckbox", "menuitemradio", "meter", "navigation", "none", "note", "option",
    "paragraph", "presentation", "progressbar", "radio", "radiogroup", "region", "row", "rowgroup", "rowheader", "scrollbar", "search", "searchbox", "separator", "slider", "spinbutton",
    "status", "strong", "subscript", "superscript", "switch", "tab", "table", "tablist", "tabpanel", "term", "textbox", "time", "timer", "toolbar", "tooltip", "tree", "treegrid", "treeitem",
]
INDICATORS = [
    "outline", "outline-color", "outline-style", "outline-width", "outline-offset", "box-shadow", "border", "border-color", "border-width", "border-bottom", "border-bottom-color",
    "background", "background-color",
]
SUPPRESSING = ["none", "0", "0px"]
FLATTENED = ["inline-style", "jss", "ts-literal"]
DIALOGS = ["dialog", "alertdialog"]
LINT_SEVERITY = {
    "error": [
        "alt-text", "anchor-has-content", "anchor-is-valid", "aria-activedescendant-has-tabindex", "aria-proptypes", "heading-has-content", "html-has-lang", "iframe-has-title",
        "interactive-supports-focus", "label-has-associated-control", "no-aria-hidden-on-focusable", "no-distracting-elements", "no-interactive-element-to-noninteractive-role", "scope",
    ],
    "warning": [
        "autocomplete-valid", "click-events-have-key-events", "lang", "media-has-caption", "mouse-events-have-key-events", "no-autofocus", "no-noninteractive-element-interactions",
        "no-noninteractive-element-to-interactive-role", "no-noninteractive-tabindex", "no-static-element-interactions", "tabindex-no-positive",
    ],
}


@rule("icon.foreign-pack", "icon", "imports")
def foreign_pack(t: Tables) -> DataFrame:
    s = F.col("specifier")
    pack = F.coalesce(*(F.when((s == p) | s.startswith(p + "/"), F.lit(p)) for p in ICON_PACKAGES))
    rows = t.imports.withColumn("_pack", pack).where("_pack is not null")
    return finding(rows, "icon.foreign-pack", "icon", "warning", 1.0, s, F.col("_pack"))


@rule("a11y.aria.required", "a11y", "elements")
def aria_required(t: Tables) -> DataFrame:
    table_ = F.create_map(*(x for k, v in REQUIRED_ATTRIBUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    role = F.col("props")["role"]
    rows = t.elements.where("kitComponent is null").withColumn("_missing", F.array_except(table_[role], F.map_keys("props"))).where(F.size("_missing") > 0)
    missing = F.array_join(F.array_sort("_missing"), ",")
    return finding(rows, "a11y.aria.required", "a11y", "error", 0.95, role, F.concat_ws(":", role, missing), role, missing)


@rule("a11y.aria.redundant", "a11y", "elements")
def aria_redundant(t: Tables) -> DataFrame:
    table_ = F.create_map(*(F.lit(x) for kv in IMPLICIT_ROLES.items() for x in kv))
    rows = t.elements.where((F.col("props")["role"] == table_[F.col("name")]))
    return finding(rows, "a11y.aria.redundant", "a11y", "info", 1.0, F.col("props")["role"], F.col("name"))


@rule("a11y.aria.invalid", "a11y", "elements")
def aria_invalid(t: Tables) -> DataFrame:
    """Abstract and unknown roles; an unknown role is suggested the one nearest role within a third of its length."""
    rows = t.elements.withColumn("_role", F.explode(F.split(F.col("props")["role"], r"\s+"))).where((F.col("_role") != "") & ~F.col("_role").isin(ROLES))
    most = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.length("_role") / 3)))
    distances = F.filter(F.transform(F.array(*map(F.lit, ROLES)), lambda r: F.struct(F.levenshtein(F.col("_role"), r).alias("d"), r.alias("r"))), lambda x: x["d"] <= most)
    best = F.filter(distances, lambda x: x["d"] == F.array_min(F.transform(distances, lambda y: y["d"])))
    abstract = F.col("_role").isin(ABSTRACT_ROLES)
    kind = F.when(abstract, "abstractRole").otherwise("unknownRole")
    return finding(rows, "a11y.aria.invalid", "a11y", "error", 1.0, F.col("_role"), F.concat(F.lit("role:"), F.col("_role")), kind, F.when(~abstract & (F.size(best) == 1), F.get(best, F.lit(0))["r"]))


@rule("a11y.lint", "a11y", "lint_messages")
def lint(t: Tables) -> DataFrame:
    severity = F.when(F.col("rule").isin(LINT_SEVERITY["error"]), "error").when(F.col("rule").isin(LINT_SEVERITY["warning"]), "warning").otherwise("info")
    return finding(t.lint_messages, "a11y.lint", "a11y", severity, F.when(severity == "error", 0.95).otherwise(0.75), F.col("message"), F.col("rule"), F.col("rule"))


@rule("a11y.focus.suppressed", "a11y", "style_values")
def focus_suppressed(t: Tables) -> DataFrame:
    """outline: none minus blocks that draw another indicator; blanket ones also minus files that style focus at all."""
    v = t.style_values.where("not dynamic").withColumn("_focus", F.coalesce(F.lower("selector").contains("focus"), F.lit(False)))
    plain = F.lower(F.trim("value"))
    none = F.col("property").isin("outline", "outline-style") & F.array_contains(F.split(plain, r"\s+"), "none")
    v = v.withColumn("_off", none | (F.col("property").isin("outline", "outline-style", "outline-width") & plain.isin(SUPPRESSING)))
    suppressing = v.where("_off")
    draws = v.where(F.col("property").isin(INDICATORS) & ~F.col("_off") & (F.trim("value") != "0"))
    bare = suppressing.join(draws.select("file", "selector").distinct(), ["file", "selector"], "left_anti")
    on_focus = finding(bare.where("_focus"), "a11y.focus.suppressed", "a11y", "error", 0.95, F.concat_ws(": ", "property", "value"), None, F.lit("onFocus"))
    blanket = bare.where(~F.col("_focus") & ~F.col("source").isin(FLATTENED)).join(draws.where("_focus").select("file").distinct(), "file", "left_anti")
    return on_focus.unionByName(finding(blanket, "a11y.focus.suppressed", "a11y", "error", 0.85, F.concat_ws(": ", "property", "value"), None, F.lit("blanket")))


@limits_of("a11y.focus.suppressed", "style_values")
def focus_unclear(t: Tables) -> DataFrame:
    return limits.focus_limitations(t.style_values, FLATTENED)


@rule("a11y.contrast.text", "a11y", "style_values")
def contrast_text(t: Tables) -> DataFrame:
    """Colour, laid over the background where it has alpha, and background of one selector (last wins); large text is 24px,
    or 18.66px and bold."""
    last = lambda p: F.max(F.when(F.col("property").isin(p), F.struct("ord", "value", "line", "column")))
    b = t.style_values.where("not dynamic").groupBy("file", "selector").agg(last(["color"]).alias("c"), last(["background-color", "background"]).alias("b"), last(["font-size"]).alias("s"), last(["font-weight"]).alias("w"))
    lum = lambda h: color.luminance(*(color.channel(h, i) for i in range(3)))
    b = b.withColumn("_c", color.canonical_hex(F.col("c.value"))).withColumn("_b", color.canonical_hex(F.col("b.value"))).where("_c is not null and _b like '%ff' and length(_b) = 8")
    size, weight = text.pixels(F.col("s.value")), F.when(F.col("w.value") == "bold", 700).otherwise(F.col("w.value").try_cast("int"))
    large = F.coalesce((size >= 24) | ((size >= 18.66) & (weight >= 700)), F.lit(False))
    b = b.withColumn("_r", color.contrast(color.luminance(*(color.composite(F.col("_c"), F.col("_b"), i) for i in range(3))), lum(F.col("_b")))).withColumn("_large", large)
    rows = b.where(F.col("_r") < F.when(F.col("_large"), color.LARGE_TEXT).otherwise(color.NORMAL_TEXT)).select(
        "file", F.col("c.line").alias("line"), F.col("c.column").alias("column"), F.col("c.ord").alias("ord"), "c", "b", "s", "_r", "_large")
    return finding(rows, "a11y.contrast.text", "a11y", F.when(F.col("_r") < 3, "error").otherwise("warning"), F.when(F.col("s").isNull(), 0.8).otherwise(0.95),
                   color.format_ratio(F.col("_r")), F.concat_ws(":", F.lower("c.value"), F.lower("b.value")), F.when(F.col("_large"), "largeText").otherwise("normalText"))


@rule("a11y.pattern.relations", "a11y", "elements")
def relations(t: Tables) -> DataFrame:
    """Ids that labelling attributes name and no element of the file declares."""
    attributes = ["aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "htmlFor"]
    named = t.elements.select("file", "line", "column", "ord", F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.col("props")[a].alias("ids")) for a in attributes))).alias("x")).where("x.ids is not null")
    ids = named.select("file", "line", "column", "ord", F.col("x.attr").alias("_attr"), F.explode(F.split("x.ids", r"\s+")).alias("_id")).where("_id <> ''")
    declared = t.elements.select("file", F.col("props")["id"].alias("_id")).where("_id is not null").distinct()
    computed = t.elements.select("file", F.explode("propExpressions").alias("_k", "_e")).groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("_e")), " ").alias("_text"))
    rows = ids.join(declared, ["file", "_id"], "left_anti").join(computed, "file", "left").where(F.col("_text").isNull() | ~F.col("_text").contains(F.col("_id")))
    return finding(rows, "a11y.pattern.relations", "a11y", "error", 0.9, F.col("_id"), F.col("_attr"), F.lit("danglingId"))


@rule("a11y.name.missing", "a11y", "elements")
def name_missing(t: Tables) -> DataFrame:
    """Buttons and links without text, label or an expression that might give one."""
    table_ = F.create_map(*(F.lit(x) for kv in IMPLICIT_ROLES.items() for x in kv))
    role = F.coalesce(F.col("props")["role"], table_[F.col("name")])
    e = t.elements.where("kitComponent is null").withColumn("_role", role).where(F.col("_role").isin("button", "link", "checkbox", "switch", "menuitem", "tab", "img"))
    labels = t.elements.where("name = 'label'").select("file", F.col("props")["htmlFor"].alias("_for")).where("_for is not null").distinct()
    known = any_of([F.map_contains_key("props", a) for a in ("aria-label", "aria-labelledby", "title", "alt")]) | F.col("hasLabelAncestor") | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    rows = e.where(~known & ~F.map_contains_key("propExpressions", F.lit("children"))).join(labels, (e["file"] == labels["file"]) & (e["props"]["id"] == labels["_for"]), "left_anti")
    return finding(rows, "a11y.name.missing", "a11y", "error", 0.9, F.col("name"), F.col("_role"), F.when(F.col("_role").isin("button", "link"), "iconOnly").otherwise("unlabelled"))


@rule("a11y.pattern.focus", "a11y", "elements", "declarations")
def pattern_focus(t: Tables) -> DataFrame:
    """Dialogs whose declaration handles no Escape: the element's owner is the last declaration at or above it."""
    dialogs = t.elements.where(F.col("props")["role"].isin(DIALOGS) & F.col("kitComponent").isNull()).select("file", "line", "column", "ord")
    owned = asof_backward(dialogs, t.declarations.select("file", "line", F.col("ord").alias("dord"), F.col("name").alias("dname")), "file", "line", {"dname": "owner", "dord": "owner_ord"}, "dord")
    first = owned.groupBy("file", "owner").agg(F.min(F.struct("line", "column", "ord")).alias("f")).select("file", "owner", "f.*")
    keyed = t.elements.where(F.array_contains("keysHandled", "Escape")).select("file", "line", "column", "ord")
    escapes = asof_backward(keyed, t.declarations.select("file", "line", F.col("ord").alias("dord"), F.col("name").alias("dname")), "file", "line", {"dname": "owner"}, "dord").select("file", "owner").distinct()
    rows = first.join(escapes, (first["file"] == escapes["file"]) & first["owner"].eqNullSafe(escapes["owner"]), "left_anti")
    return finding(rows, "a11y.pattern.focus", "a11y", "error", 0.85, F.col("owner"), None, F.lit("noEscape"))


@rule("font.foreign", "font", "style_values")
def font_foreign(t: Tables, stack: tuple[str, ...] = ("inter", "sans-serif", "inherit", "initial", "unset")) -> DataFrame:
    families = F.filter(style.font_families(F.col("value")), lambda x: ~x.isin(*stack))
    rows = t.style_values.where("property = 'font-family' and not contains(value, 'var(')").withColumn("_f", families).where(F.size("_f") > 0)
    return finding(rows, "font.foreign", "font", "error", 1.0, F.col("value"), F.array_join("_f", ","))


#: Fixed value: alphas closer than this count as one.
ALPHA_TOLERANCE = 0.02


def value_literals(style_values: DataFrame, kind: str) -> DataFrame:
    """Literals of one kind in style values: raw, and column where it starts; colour words are none in script texts."""
    found = values.value_literals(style_values, "value", F.coalesce(F.col("source") != "ts-literal", F.lit(True))).where(F.col("kind") == kind)
    return found.withColumn("column", edits.literal_column(F.col("column"), F.col("source"), F.col("property"), F.col("offset")).cast("int"))


@rule("token.literal.color", "token", "style_values", "tokens")
def literal_color(t: Tables) -> DataFrame:
    """Each colour literal with its nearest token of like alpha; distinct literals meet the tokens of the cells around them.

    Tokens may have a role and a tier: among equals a token of the property's role comes first, then the smaller id. A
    colour without a role that a semantic token has too is ambiguous, which lowers the confidence.
    """
    role = F.when(F.col("source") != "ts-literal", style.color_role(F.col("property")))
    literals = value_literals(t.style_values, "color").select("file", "line", "column", "ord", F.col("raw").alias("_l"), F.coalesce(role, F.lit("")).alias("_role"), color.canonical_hex(F.col("raw")).alias("_h"))
    literals = cut(literals).where("_h is not null")
    lab = lambda h, p: [x.alias(p + n) for x, n in zip(color.oklab(*(color.channel(h, i) for i in range(3))), "lab", strict=True)]
    alpha = lambda h: round_half_up(color.channel(F.col(h), 3) / 255, 4)
    distinct = literals.select("_h", "_role").distinct().select("_h", "_role", *lab(F.col("_h"), "x"))
    own = lambda c: F.col(c) if c in t.tokens.columns else F.lit(None).cast("string")
    tokens = t.tokens.select(F.col("id").alias("_t"), color.canonical_hex(F.col("hex")).alias("_k"), own("role").alias("_r"), own("tier").alias("_tier")).where("_k is not null").select("*", *lab(F.col("_k"), "y"))
    own_point, token_point = [F.col("x" + n) for n in "lab"], [F.col("y" + n) for n in "lab"]
    distinct, tokens = cut(distinct), cut(tokens)  # coordinates are worked out once
    pairs = pairs_within(distinct, tokens, own_point, token_point, color.SHADE).where(F.abs(alpha("_h") - alpha("_k")) < ALPHA_TOLERANCE)
    order = F.struct((F.col("_h") != F.col("_k")).alias("other"), color.distance(own_point, token_point).alias("d"), (~F.col("_r").eqNullSafe(F.col("_role"))).alias("apart"), F.col("_t").alias("t"))
    best = pairs.groupBy("_h", "_role").agg(F.min(order).alias("_b"))
    twins = tokens.where("_tier = 'semantic'").groupBy(F.col("_k").alias("_h")).agg(F.collect_set("_t").alias("_twins"))
    rows = literals.join(best, ["_h", "_role"], "left").join(twins, "_h", "left")
    kind = F.when(~F.col("_b.other"), "exact").when(F.col("_b.d") < color.NEAR, "near").when(F.col("_b.d") < color.SHADE, "shade").otherwise("foreign")
    ambiguous = (F.col("_role") == "") & (kind == "exact") & F.coalesce(F.size(F.array_except("_twins", F.array("_b.t"))) > 0, F.lit(False))
    return finding(rows, "token.literal.color", "token", F.when(kind == "exact", "error").when(kind == "shade", "info").otherwise("warning"),
                   F.when(ambiguous, 0.7).when(kind == "exact", 1.0).when(kind == "foreign", 0.9).otherwise(0.85), F.col("_l"), F.lower("_l"), kind, F.when(kind != "foreign", F.col("_b.t")))


@rule("api.dnu", "api", "imports")
def do_not_use(t: Tables, marker: str = "do-not-use") -> DataFrame:
    return finding(t.imports.where(F.lower("specifier").contains(marker)), "api.dnu", "api", "error", 1.0, F.col("specifier"), F.col("specifier"))


@rule("import.internal", "api", "imports", "kit_packages")
def import_internal(t: Tables) -> DataFrame:
    """Deep imports of a kit package that it does not export (a trailing * exports a prefix)."""
    rows = t.imports.withColumn("_p", text.package_name(F.col("specifier"))).where(text.is_deep(F.col("specifier")))
    kit = t.kit_packages.select(F.col("package").alias("_p"), "exports")
    sub = F.concat(F.lit("."), F.expr("substring(specifier, length(_p) + 1)"))
    open_ = F.exists("exports", lambda x: (sub == x) | (x.endswith("*") & sub.startswith(F.regexp_replace(x, r"\*$", ""))))
    return finding(rows.join(kit, "_p").where(~open_), "import.internal", "api", "error", 1.0, F.col("specifier"), F.col("_p"))


@rule("import.bypass", "api", "imports", "upstream")
def import_bypass(t: Tables) -> DataFrame:
    up = t.upstream.groupBy(F.col("package").alias("_p")).agg(F.array_join(F.array_sort(F.collect_set("wrapper")), ",").alias("_w"))
    rows = t.imports.where("not typeOnly").withColumn("_p", text.package_name(F.col("specifier"))).join(up, "_p")
    return finding(rows, "import.bypass", "api", "error", 1.0, F.col("specifier"), F.col("specifier"), None, F.col("_w"))


@limits_of("import.bypass", "imports")
def nothing_wrapped(t: Tables) -> DataFrame:
    """Said once for the project: the dictionary wraps no package, so there is nothing to bypass."""
    once = t.imports.sparkSession.range(1) if t.upstream is None else t.upstream.agg(F.count("*").alias("n")).where("n = 0")
    return limits.project_limitation(once, "no-upstream", "import.bypass: no wrapped packages to check against")


@rule("api.deprecated", "api", "elements", "imports", "symbols")
def api_deprecated(t: Tables) -> DataFrame:
    used = t.elements.where("kitComponent is not null").select("file", "line", "column", "ord", F.col("kitComponent").alias("_s")).unionByName(
        t.imports.select("file", "line", "column", "ord", F.explode("names.imported").alias("_s")))
    first = used.groupBy("file", "line", "_s").agg(F.min(F.struct("column", "ord")).alias("f")).select("file", "line", "_s", "f.*")
    return finding(first.join(t.symbols.select(F.col("name").alias("_s"), "note"), "_s"), "api.deprecated", "api", "warning", 1.0, F.col("_s"), F.col("_s"), None, F.col("note"))


@rule("prop.invalid", "api", "elements", "variants")
def prop_invalid(t: Tables) -> DataFrame:
    """Literal values outside a prop's legal set, with the nearest legal value."""
    used = t.elements.where("kitComponent is not null").select("file", "line", "column", "ord", F.col("kitComponent").alias("component"), F.explode("props").alias("prop", "_v")).where("_v is not null")
    bad = used.join(sorted_join(t.variants), ["component", "prop"]).where(~F.array_contains("legal", F.col("_v")))
    most = F.greatest(F.lit(1), F.floor(F.length("_v") / 2))
    near = F.array_min(F.filter(F.transform("legal", lambda x: F.struct(F.levenshtein(F.col("_v"), x).alias("d"), x.alias("x"))), lambda s: s["d"] <= most))
    return finding(bad, "prop.invalid", "api", "error", 1.0, F.col("_v"), F.concat(F.col("component"), F.lit("."), F.col("prop"), F.lit("="), F.col("_v")), None, near["x"])


def applicable(tables: Tables, categories: list[str] | None = None) -> list[Rule]:
    """Rules of the wanted categories whose tables are there."""
    import sparkloom.plans.rules_kit  # noqa: F401  registers the rules of a dictionary

    return [r for r in REGISTRY.values() if (categories is None or r.category in categories) and all(getattr(tables, n) is not None for n in r.needs)]


def numbered(found: DataFrame) -> DataFrame:
    """Findings in total order, with occurrences and distinct files of their impactKey, and f_0001 ids."""
    rows = global_number(found, ["file", "line", "column", "rule", "actual", "subkind", "ord"])
    impact = rows.groupBy("impactKey").agg(F.count("*").alias("occurrences"), F.countDistinct("file").alias("files"))
    return rows.join(impact, "impactKey").select(F.format_string("f_%04d", "number").alias("id"), *FINDING, "occurrences", "files")


def run_rules(tables: Tables, categories: list[str] | None = None) -> DataFrame:
    """Findings of all rules that apply, numbered."""
    return numbered(reduce(DataFrame.unionByName, [r.run(tables) for r in applicable(tables, categories)]))


def rule_limitations(tables: Tables, categories: list[str] | None = None) -> list[DataFrame]:
    """What the rules of the wanted categories could not check, with the rule in front; a rule that does not apply for
    want of its dictionary says so here."""
    import sparkloom.plans.rules_kit  # noqa: F401  registers the rules of a dictionary

    wanted = [(i, x) for i, x in LIMITS.items() if categories is None or REGISTRY[i].category in categories]
    return [x.run(tables).withColumn("rule", F.lit(i)) for i, x in wanted if all(getattr(tables, n) is not None for n in x.needs)]


def check(tables: Tables, categories: list[str] | None = None, scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and limitations of all rules from one job over the facts: a union of tagged rows, written once, then split.

    Limitations have the rule, null for those of the scan (``scanned``), and each row once, in order of file, line (none
    first), reason and detail. Without any rule or limitation the frames are empty.
    """
    spark = next(v for v in vars(tables).values() if isinstance(v, DataFrame)).sparkSession
    types = StructType.fromDDL(FINDING_ROW)
    shape = f"finding struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in types)}>, limitation struct<rule:string,file:string,line:int,reason:string,detail:string>"
    none = spark.createDataFrame([], shape)
    found = [r.run(tables).select(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in types)).alias("finding")) for r in applicable(tables, categories)]
    limited = rule_limitations(tables, categories) + ([scanned.withColumn("rule", F.lit(None).cast("string"))] if scanned is not None else [])
    tagged = [x.select(F.struct("rule", "file", "line", "reason", "detail").alias("limitation")) for x in limited]
    both = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [none, *found, *tagged]))
    said = both.where("limitation is not null").select("limitation.*").distinct()
    return numbered(both.where("finding is not null").select("finding.*")), said.orderBy("file", F.coalesce("line", F.lit(0)), "reason", "detail", "rule")
