"""Edits of source lines: exact places, deletions, mechanical fixes, patched lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that have a mechanical fix, and sources whose value follows its property on the line.
POSITIVE_TABINDEX = r"^(tabIndex|tabindex)(\s*=\s*)(\{\s*[0-9]+\s*\}|\"[0-9]+\"|'[0-9]+')"
AUTOFOCUS = r"^(?:autoFocus|autofocus)(?:\s*=\s*(?:\{[^{}]*\}|\"[^\"]*\"|'[^']*'))?"
PROPERTY_FIRST = ["css", "scss", "css-modules", "scss-modules", "less", "styled-components", "emotion"]


def occurs_on(line: Column, text: Column) -> Column:
    return F.coalesce(line.contains(text), F.lit(False))


def deletion_of(line: Column, attribute: Column) -> Column:
    """The attribute as it stands on the line, with the space before it if there is one; null if it is not there."""
    at = F.locate(attribute, line) if isinstance(attribute, str) else F.instr(line, attribute)
    return F.when(at > 1, F.when(F.substring(line, at - 1, F.lit(1)) == " ", F.concat(F.lit(" "), attribute)).otherwise(attribute)).when(at == 1, attribute)


def lint_fix(rule: Column, line: Column, column: Column) -> Column:
    """struct<actual, replaceWith> of the two rules with a mechanical fix, read at a 1-based column; null where none applies."""
    rest = F.when((column >= 1) & (column <= F.length(line)), F.substring(line, column, F.length(line)))
    tab, value = F.regexp_extract(rest, POSITIVE_TABINDEX, 0), F.regexp_extract(rest, POSITIVE_TABINDEX, 3)
    zero = F.when(value.startswith("{"), "{0}").when(value.startswith('"'), '"0"').otherwise("'0'")
    head = F.concat(F.regexp_extract(rest, POSITIVE_TABINDEX, 1), F.regexp_extract(rest, POSITIVE_TABINDEX, 2), zero)
    focus = F.regexp_extract(rest, AUTOFOCUS, 0)
    spaced = F.when((column > 1) & (F.substring(line, column - 1, F.lit(1)) == " "), F.concat(F.lit(" "), focus)).otherwise(focus)
    pair = lambda a, b: F.struct(a.alias("actual"), b.alias("replaceWith"))
    return F.when((rule == "tabindex-no-positive") & (tab != ""), pair(tab, head)).when((rule == "no-autofocus") & (focus != ""), pair(spaced, F.lit("")))


def patched(line: Column, actual: Column, replacement: Column, whole: bool = False) -> Column:
    """The line with the first ``actual`` replaced; ``whole`` lines keep their indent and a last semicolon. Null if it is not there."""
    at = F.instr(line, actual)
    if whole:
        end = F.when(F.rtrim(line).endswith(";"), ";").otherwise("")
        return F.when(at > 0, F.concat(F.regexp_extract(line, r"^\s*", 0), replacement, end))
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), replacement, F.substring(line, at + F.length(actual), F.length(line))))


def literal_column(column: Column, source: Column, prop: Column, offset: Column) -> Column:
    """Start column of a literal at an offset in a value, from the column of its declaration."""
    return column + F.when(source.isin(PROPERTY_FIRST), F.length(prop) + 2).otherwise(0) + offset
