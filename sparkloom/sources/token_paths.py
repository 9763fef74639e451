"""References of style factories to tokens: member paths, templates and spreads, tied to what the file imports.

The scanner writes down every expression in the objects of a factory with its root and its members; Spark joins the roots
to the imports of the same file, so that one value has one identity (module, export, path), however it was imported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import cut, sorted_join
from sparkloom.sources.scripts import Script, _each, _names, closing
from sparkloom.sources.typed import LITERAL

AT = "file string, line int, column int, ord int, "
BINDINGS = AT + "local string, module string, exportName string"
EXPRESSIONS = AT + "factory string, owner string, selector string, property string, text string, spread boolean, parts array<struct<root:string,path:array<string>,computed:boolean>>"
#: The calls that make styles, the packages and file names that say so, and how spreads are named.
FACTORIES = ["style", "styleVariants", "globalStyle", "recipe", "createTheme", "createGlobalTheme"]
SCOPE, FILES, SPREAD = "@vanilla-extract/", r"\.css\.[cm]?[jt]sx?$", "..."

CALL = re.compile(r"\b(" + "|".join(FACTORIES) + r")\s*(?:<[^>()]*>)?\s*\(")
OWNER = re.compile(r"(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\[[^\]]*\]|\{[^}]*\})\s*(?::[^=\n]*)?=\s*(?:[\w$]+\.)*$")
PATH = re.compile(r"""\s*([A-Za-z_$][\w$]*)((?:\s*\??\.\s*[A-Za-z_$][\w$]*|\s*(?:\?\.)?\[[^\[\]]*\])*)\s*!?\s*$""")
STEP = re.compile(r"""\??\.\s*([A-Za-z_$][\w$]*)|\[\s*(?:(["'])([^"']*)\2|([^\]]*))\s*\]""")
KEY = re.compile(r"""\s*(?:(["'])(?P<q>[^"'\n]*)["']|(?P<n>[A-Za-z_$][\w$-]*|\d[\w.]*)|(?P<c>\[[^\]]*\]))\s*:""")
WORDS = {"undefined", "null", "true", "false", "NaN", "Infinity"}


def member_path(text: str) -> dict | None:
    """Root and members of ``a.b['c']``; a subscript that is no literal makes it computed. Null for all else."""
    m = PATH.fullmatch(text)
    if not m or m[1] in WORDS:
        return None
    path, computed = [], False
    for name, _, quoted, other in STEP.findall(m[2]):
        if other.strip():
            computed = True
        else:
            path.append(name or quoted)
    return {"root": m[1], "path": path, "computed": computed}


def template_parts(text: str) -> list[str]:
    """Expressions in the ``${...}`` of a template, in order."""
    out, at = [], 0
    while (start := text.find("${", at)) >= 0:
        depth, end = 1, start + 2
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        out.append(text[start + 2 : end - 1])
        at = end
    return out


def inner_objects(s: Script, start: int, end: int) -> list[int]:
    """Braces of the object literals among the arguments of a call, in lists too, but not in what they hold or call."""
    out, at = [], start
    while at < end:
        c = s.code[at]
        if c == "{":
            out.append(at)
        if c in "{(" and (to := closing(s.code, at)) > 0:
            at = to
        at += 1
    return out


def expressions(s: Script) -> Iterator[tuple]:
    """(at, factory, owner, selector, property, text, spread, parts) of every value that is no literal, in order."""
    found, done = [], -1
    for call in CALL.finditer(s.code):
        end = closing(s.code, call.end() - 1)
        if end < 0 or call.start() < done:
            continue
        done = end
        before = OWNER.search(s.code[: call.start()][-200:])
        owner = before[1] if before else None
        head = LITERAL.match(s.text[call.end() : end].lstrip()) if call[1] == "globalStyle" else None
        open_ = [(b, closing(s.code, b), head[2] if head else None) for b in inner_objects(s, call.end(), end)]
        while open_:
            brace, stop, selector = open_.pop()
            at = brace + 1
            while at < stop:
                to = s._comma(at, stop)
                first = at + len(s.code[at:to]) - len(s.code[at:to].lstrip())
                key = KEY.match(s.text, first)
                if s.code.startswith(SPREAD, first):
                    text = s.text[first + len(SPREAD) : to].strip()
                    part = member_path(text)
                    found.append((first, call[1], owner, selector, SPREAD, text, True, [part] if part else []))
                elif key and key.end() <= to:
                    name = next(x for x in (key["q"], key["n"], key["c"]) if x is not None)
                    value = key.end() + len(s.code[key.end() : to]) - len(s.code[key.end() : to].lstrip())
                    below = name if selector is None else f"{selector} {name}"
                    if s.code[value : value + 1] == "{" and closing(s.code, value) > 0:
                        open_.append((value, closing(s.code, value), below))
                    elif s.code[value : value + 1] == "[" and (inner := inner_objects(s, value + 1, closing(s.code, value))):
                        open_ += [(b, closing(s.code, b), below) for b in inner]
                    else:
                        items = [s.text[value:to]]
                        if s.code[value : value + 1] == "[" and (close := closing(s.code, value)) > 0:
                            items, item = [], value + 1
                            while item < close:
                                items.append(s.text[item : (item := s._comma(item, close))])
                                item += 1
                        for item in items:
                            for branch in s._branches(item.strip()):
                                texts = template_parts(branch) if branch.startswith("`") else [branch]
                                parts = [p for x in texts if (p := member_path(x))]
                                if parts:
                                    found.append((first, call[1], owner, selector, name, branch, False, parts))
                at = to + 1
    yield from sorted(found, key=lambda x: x[0])


def bindings(files: DataFrame) -> DataFrame:
    """(file, local, module, exportName) of value imports; ``default`` and ``*`` stand for default and namespace imports."""
    def facts(s: Script):
        for at, kind, type_only, clause, specifier in s.statements():
            if kind == "import" and not type_only:
                default = re.match(r"([A-Za-z_$][\w$]*)\s*(?:,|$)", clause)
                whole = re.search(r"\*\s*as\s+([A-Za-z_$][\w$]*)", clause)
                if default:
                    yield at, default[1], specifier, "default"
                if whole:
                    yield at, whole[1], specifier, "*"
                for imported, local, typed in _names(clause):
                    if not typed:
                        yield at, local, specifier, imported

    return _each(files, BINDINGS, facts)


def token_references(files: DataFrame, factories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """References (file, line, column, ord, factory, owner, selector, property, text, spread, module, exportName, path) and
    limitations.

    A file takes part if its name says so, or if it imports from a package of the scope or one of ``factories`` (module,
    name). Of a template's references the first that can be read counts. What hangs on an import but has a computed
    member, and a spread that is no path of an import, is a limitation; other expressions are the file's own business.
    """
    known = cut(bindings(files))  # read by the choice of files and by the look-up
    by_package = known.where(F.col("module").startswith(SCOPE)).select("file")
    if factories is not None:
        by_package = by_package.unionByName(known.join(factories.select("module", F.col("name").alias("exportName")), ["module", "exportName"]).select("file"))
    taking = files.where(F.col("file").rlike(FILES)).select("file").unionByName(by_package).distinct()
    first = known.groupBy("file", F.col("local").alias("root")).agg(F.min(F.struct("ord", "module", "exportName")).alias("b"))
    rows = cut(_each(files.join(sorted_join(taking), "file", "left_semi"), EXPRESSIONS, expressions))  # read by four joins
    parts = rows.select("file", "ord", F.posexplode("parts").alias("nth", "p")).select("file", "ord", "nth", "p.*").join(sorted_join(first), ["file", "root"])
    star = F.col("b.exportName") == "*"
    parts = parts.where(~star | (F.size("path") > 0) | F.col("computed"))
    target = F.struct(
        "nth", F.col("b.module").alias("module"), F.when(star, F.get("path", F.lit(0))).otherwise(F.col("b.exportName")).alias("exportName"),
        F.when(star, F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path")).alias("path"))
    met = parts.groupBy("file", "ord").agg(F.min(F.when(~F.col("computed"), target)).alias("t"), F.bool_or("computed").alias("computed"))
    both = rows.join(sorted_join(met), ["file", "ord"], "left")
    place = ["file", "line", "column", "ord", "factory", "owner", "selector", "property", "text", "spread"]
    references = both.where("t is not null").select(*place, "t.module", "t.exportName", "t.path")
    detail = F.when(F.col("computed"), "computed member in a token reference").when(F.col("spread") & F.col("t").isNull(), "spread is no path of an import")
    unread = both.withColumn("d", detail).where("d is not null")
    said = F.concat("property", F.when(F.col("spread"), "").otherwise(": "), "text", F.lit(" - "), "d")
    return references, unread.select("file", "line", F.lit("unsupported-syntax").alias("reason"), said.alias("detail"))


def unexpandable_spreads(references: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Limitations for spread references (module, exportName, path) that the dictionary's paths do not hold."""
    known = dictionary.select("module", "exportName", F.array_join("path", ".").alias("_path")).distinct()
    rows = references.where("spread").withColumn("_path", F.array_join("path", ".")).join(sorted_join(known), ["module", "exportName", "_path"], "left_anti")
    return rows.select("file", "line", F.lit("unsupported-syntax").alias("reason"), F.concat(F.lit(SPREAD), "text", F.lit(" - spread that the dictionary cannot expand")).alias("detail"))
