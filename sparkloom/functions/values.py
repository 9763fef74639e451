"""Literals of style values: one left-to-right reading that gives kind, text and offset of each.

A value is read once from the left: comments, colours written as hex digits, lengths with a unit, ``var(--x)``, colour
functions with all their brackets, colour words. What stands in ``var(...)`` after the name and all of ``url(...)`` is
left out, as are bare numbers. A function whose brackets do not close gives nothing itself; reading goes on after its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Functions that are colours, functions that are left out, units, and the colour words of the web.
COLOR_FUNCTIONS = ["rgb", "rgba", "hsl", "hsla", "hwb", "lab", "lch", "oklab", "oklch", "color"]
SKIPPED_FUNCTIONS = ["url"]
UNITS = ["px", "rem", "em", "vh", "vw", "vmin", "vmax", "ch", "ex", "cm", "mm", "in", "pt", "pc", "q"]
COLOR_WORDS = [
    "aliceblue", "antiquewhite", "aqua", "aquamarine", "azure", "beige", "bisque", "black", "blanchedalmond", "blue", "blueviolet", "brown", "burlywood", "cadetblue", "chartreuse",
    "chocolate", "coral", "cornflowerblue", "cornsilk", "crimson", "cyan", "darkblue", "darkcyan", "darkgoldenrod", "darkgray", "darkgreen", "darkgrey", "darkkhaki", "darkmagenta",
    "darkolivegreen", "darkorange", "darkorchid", "darkred", "darksalmon", "darkseagreen", "darkslateblue", "darkslategray", "darkslategrey", "darkturquoise", "darkviolet", "deeppink",
    "deepskyblue", "dimgray", "dimgrey", "dodgerblue", "firebrick", "floralwhite", "forestgreen", "fuchsia", "gainsboro", "ghostwhite", "gold", "goldenrod", "gray", "green", "greenyellow",
    "grey", "honeydew", "hotpink", "indianred", "indigo", "ivory", "khaki", "lavender", "lavenderblush", "lawngreen", "lemonchiffon", "lightblue", "lightcoral", "lightcyan",
    "lightgoldenrodyellow", "lightgray", "lightgreen", "lightgrey", "lightpink", "lightsalmon", "lightseagreen", "lightskyblue", "lightslategray", "lightslategrey", "lightsteelblue",
    "lightyellow", "lime", "limegreen", "linen", "magenta", "maroon", "mediumaquamarine", "mediumblue", "mediumorchid", "mediumpurple", "mediumseagreen", "mediumslateblue",
    "mediumspringgreen", "mediumturquoise", "mediumvioletred", "midnightblue", "mintcream", "mistyrose", "moccasin", "navajowhite", "navy", "oldlace", "olive", "olivedrab", "orange",
    "orangered", "orchid", "palegoldenrod", "palegreen", "paleturquoise", "palevioletred", "papayawhip", "peachpuff", "peru", "pink", "plum", "powderblue", "purple", "rebeccapurple", "red",
    "rosybrown", "royalblue", "saddlebrown", "salmon", "sandybrown", "seagreen", "seashell", "sienna", "silver", "skyblue", "slateblue", "slategray", "slategrey", "snow", "springgreen",
    "steelblue", "tan", "teal", "thistle", "tomato", "turquoise", "violet", "wheat", "white", "whitesmoke", "yellow", "yellowgreen",
]

LITERAL = ArrayType(StructType([StructField("kind", StringType()), StructField("raw", StringType()), StructField("offset", IntegerType())]))
_TOKEN = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z))|(?P<hex>#[0-9a-f]{3,8}\b)|(?P<length>-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:" + "|".join(UNITS) + r")\b)|(?P<word>-{0,2}[a-z_][\w-]*)", re.I | re.S | re.A)
_NAME = re.compile(r"var\(\s*(--[\w-]+)", re.A)
_BRACKET = re.compile(r"[()]")
_WORDS, _COLORS, _SKIPPED = frozenset(COLOR_WORDS), frozenset(COLOR_FUNCTIONS), frozenset(SKIPPED_FUNCTIONS)


def closed(value: str, at: int) -> int:
    """End of the bracket that opens at ``at``; -1 if it stays open."""
    depth = 0
    for m in _BRACKET.finditer(value, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return -1


def read(value: str, words: bool = True) -> Iterator[tuple[str, str, int]]:
    """(kind, raw, offset) of the literals of a value: color, dimension, var (raw is its name)."""
    at = 0
    while m := _TOKEN.search(value, at):
        at = m.end()
        kind, raw = m.lastgroup, m[0]
        if kind == "hex" or kind == "length":
            yield "color" if kind == "hex" else "dimension", raw, m.start()
        elif kind == "word":
            lowered, call = raw.lower(), value[at : at + 1] == "("
            if not call:
                if words and lowered in _WORDS:
                    yield "color", raw, m.start()
                continue
            end = closed(value, at)
            if lowered == "var" and end > 0 and (name := _NAME.match(value, m.start(), end)):
                yield "var", name[1], m.start()
            if end > 0 and lowered in _COLORS:
                yield "color", value[m.start() : end], m.start()
            if end > 0 and (lowered == "var" or lowered in _COLORS or lowered in _SKIPPED):
                at = end


def _column(values: pd.Series, words: pd.Series) -> pd.Series:
    """Distinct values of a batch are read once."""
    known: dict = {}
    for key in dict.fromkeys(zip(values, words, strict=True)):
        value, named = key
        known[key] = None if value is None else [{"kind": k, "raw": r, "offset": o} for k, r, o in read(value, bool(named))]
    return pd.Series([known[key] for key in zip(values, words, strict=True)])


def literals(value: Column, words: Column | bool = True) -> Column:
    """array<struct<kind, raw, offset>> of a value, in order; colour words count only where ``words`` holds. Null for null."""
    return F.pandas_udf(_column, LITERAL)(value, words if isinstance(words, Column) else F.lit(words))


def value_literals(rows: DataFrame, value: str = "value", words: Column | bool = True) -> DataFrame:
    """The rows with one row for each literal of ``value``: kind, raw and offset beside all columns; rows without literals go."""
    found = rows.withColumn("_literal", F.explode(literals(F.col(value), words)))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("_literal.kind").alias("kind"), F.col("_literal.raw").alias("raw"), F.col("_literal.offset").alias("offset"))
