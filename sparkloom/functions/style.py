"""Style properties and values: roles, scales, categories, lengths, font lists, drawn shapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import fnv1a

# What is known of properties. The first row that gives a fact and whose pattern is the whole name decides.
BORDERS = "(border|outline|column-rule)(-(top|right|bottom|left|block|inline|start|end))*(-color|-width|-style)?"
PROPERTIES = [
    ("background|background-color", {"role": "background"}),
    ("color|fill|stroke|caret-color", {"role": "foreground"}),
    (BORDERS, {"role": "border", "scale": "borderWidthPx"}),
    ("border-radius|border-.*-radius", {"scale": "borderRadiusPx"}),
    ("font-size", {"scale": "fontSizePx"}),
    ("line-height", {"scale": "lineHeightPx"}),
    ("padding|padding-.*", {"scale": "none", "category": "size"}),
    ("gap|row-gap|column-gap", {"scale": "none"}),
    ("height|min-height|max-height", {"category": "size"}),
    ("color|opacity|box-shadow|fill|stroke|backdrop-filter|filter|line-height|letter-spacing", {"category": "repaint"}),
    ("(background|border|outline|font|text-).*", {"category": "repaint"}),
]
TYPOGRAPHY = {"font-family": "fontFamily", "font-size": "fontSize", "font-weight": "fontWeight", "line-height": "lineHeight", "letter-spacing": "letterSpacing"}
SHAPES = r"(?i)<(?:path|circle|rect|ellipse|line|polyline|polygon)\b[^>]*>"
SHAPE_NUMBERS = {"circle": ["cx", "cy", "r"], "rect": ["x", "y", "width", "height", "rx", "ry"], "ellipse": ["cx", "cy", "rx", "ry"], "line": ["x1", "y1", "x2", "y2"]}


def property_fact(prop: Column, fact: str) -> Column:
    """A fact of a property by the table; null where it has none."""
    known = [F.when(F.lower(prop).rlike(f"^(?:{pattern})$"), facts[fact]) for pattern, facts in PROPERTIES if fact in facts]
    return F.coalesce(*known)


def color_role(prop: Column) -> Column:
    """background, foreground or border; null for properties without a role."""
    return property_fact(prop, "role")


def dimension_scale(prop: Column) -> Column:
    """The scale that lengths of a property are judged by: a name, "none" where only habits can, null where nothing is."""
    return property_fact(prop, "scale")


def style_category(prop: Column) -> Column:
    """size, repaint, or layout for all the rest."""
    return F.coalesce(property_fact(prop, "category"), F.lit("layout"))


def is_important(important: Column, value: Column) -> Column:
    return important | value.rlike(r"(?i)!\s*important\s*$")


def font_families(value: Column) -> Column:
    """Families of a list, lower case, without quotes; empty ones dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, "[\"']", "")))), lambda x: x != "")


def _rounded(number: Column) -> Column:
    x = number.try_cast("double")
    cents = F.when(x < 0, -F.floor(-x * 100 + 0.5)).otherwise(F.floor(x * 100 + 0.5))
    return F.regexp_replace((cents / 100).cast("string"), r"\.0$", "")


def shape_data(data: Column) -> Column:
    """Path or point data with one kind of separator and numbers of two decimals."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(data, ",", " "), r"\s+", " "), " ?([a-zA-Z]) ?", "$1")
    parts = F.regexp_extract_all(text, F.lit(r"-?[0-9]*\.?[0-9]+(?:[eE]-?[0-9]+)?|[^0-9.-]+|."), F.lit(0))
    return F.trim(F.array_join(F.transform(parts, lambda x: F.coalesce(F.when(x.rlike("[0-9]"), _rounded(x)), x)), ""))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute; null if absent."""
    found = F.regexp_extract_all(tag, F.lit(rf"(?:\s){name}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.get(found, F.lit(0))


def _shape(tag: Column) -> Column:
    """kind:data of one shape tag; null if it draws nothing that can be read."""
    kind = F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1))
    data = lambda name: F.when(F.length(_attribute(tag, name)) > 0, F.concat(kind, F.lit(":"), shape_data(_attribute(tag, name))))
    out = F.when(kind == "path", data("d")).when(kind.isin("polyline", "polygon"), data("points"))
    for name, numbers in SHAPE_NUMBERS.items():
        values = [F.coalesce(_rounded(_attribute(tag, a)), _attribute(tag, a), F.lit("")) for a in numbers]
        out = out.when(kind == name, F.when(F.concat(*values) != "", F.concat(F.lit(name + ":"), F.array_join(F.array(*values), " "))))
    return out


def svg_fingerprint(markup: Column) -> Column:
    """Eight hex digits of what an SVG draws, in order; null without static shapes."""
    shapes = F.filter(F.transform(F.regexp_extract_all(markup, F.lit(SHAPES), F.lit(0)), _shape), lambda x: x.isNotNull())
    return F.when(F.size(shapes) > 0, F.lpad(F.lower(F.hex(fnv1a(F.array_join(shapes, "|")))), 8, "0"))
