"""Typed facts of scripts: variant sets, props and slots of exported types, deprecated paths, and the legal values of props.

Read by the scanner of :mod:`sparkloom.sources.scripts`, file by file; no types are resolved. What is split over several
files (a prop whose type is a variant set elsewhere) is joined by Spark in :func:`legal_values`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import cut, sorted_join
from sparkloom.sources.scripts import CLOSING, Script, _each, closing

AT = "file string, line int, column int, ord int, "
VARIANT_SETS = AT + "name string, kind string, keys array<string>, values map<string,string>, deprecatedKeys array<string>"
TYPES = AT + "name string, extends array<string>, members array<struct<name:string,optional:boolean,type:string,doc:string,deprecated:boolean>>, doc string, deprecated boolean"
PATHS = AT + "path string"
#: The endings of the types that hold props and slots.
PROPS, SLOTS = "Props", "Classes"

VARIABLE = re.compile(r"(?m)^[ \t]*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n{]*)?=\s*(?=\{)")
AS_CONST = re.compile(r"\s*as\s+const\b")
ALIAS = re.compile(r"(?m)^[ \t]*export\s+type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=\n]*>)?\s*=")
INTERFACE = re.compile(r"(?m)^[ \t]*export\s+(?:default\s+)?interface\s+([A-Za-z_$][\w$]*)\s*([^{]*)\{")
KEY = re.compile(r"""\s*(?:(["'])(?P<q>[^"'\n]*)["']|(?P<n>[A-Za-z_$][\w$]*|\d[\w.]*|\[[^\]\n]*\]))\s*:""")
MEMBER = re.compile(r"""\s*(?:readonly\s+)?(?:(["'])(?P<q>[^"'\n]*)["']|(?P<n>[A-Za-z_$][\w$]*))\s*(?P<o>\??)\s*(?=[:(<])""")
NEXT = re.compile(r"""\s*(?:$|\}|(?:readonly\s+)?(?:["'][^"'\n]*["']|[A-Za-z_$][\w$]*)\s*\??\s*[:(<]|\[)""")
LITERAL = re.compile(r"""(["'])((?:\\.|(?!\1).)*)\1""")
DOC = re.compile(r"/\*\*(?!/)(.*?)\*/", re.S)


def doc(gap: str) -> tuple[str | None, bool]:
    """Text before the tags of the last doc comment in ``gap``, and whether it is marked deprecated."""
    found = DOC.findall(gap)
    if not found:
        return None, False
    lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in found[-1].strip().split("\n")]
    first_tag = next((i for i, x in enumerate(lines) if x.startswith("@")), len(lines))
    return " ".join(" ".join(lines[:first_tag]).split()) or None, any(x.startswith("@deprecated") for x in lines)


def before(s: Script, at: int) -> str:
    """The comments and blanks that stand before a place."""
    start = at
    while start and s.code[start - 1].isspace():
        start -= 1
    return s.text[start:at]


def end_of(code: str, at: int, end: int, marks: str) -> int:
    """The first of ``marks`` from ``at`` on outside all brackets, angles too; ``end`` if there is none."""
    angles = 0
    while at < end:
        c = code[at]
        if c in CLOSING:
            to = closing(code, at)
            if to < 0:
                return end
            at = to
        elif c == "<":
            angles += 1
        elif c == ">" and code[at - 1] != "=":
            angles = max(0, angles - 1)
        elif not angles and c in marks:
            return at
        at += 1
    return end


def properties(s: Script, brace: int) -> Iterator[tuple[int, str, str, int, int]]:
    """(at, name, gap, start, stop) of the ``key: value`` properties on one level of an object literal."""
    end, at = closing(s.code, brace), brace + 1
    while at < end:
        stop = s._comma(at, end)
        first = at + len(s.code[at:stop]) - len(s.code[at:stop].lstrip())
        if first < stop and (key := KEY.match(s.text, first)) and key.end() <= stop:
            yield first, key["q"] if key["q"] is not None else key["n"], s.text[at:first], key.end(), stop
        at = stop + 1


def plain(value: str) -> str | None:
    """A literal as text: strings, numbers, booleans; null for all else."""
    value = value.strip()
    text = LITERAL.fullmatch(value)
    if text:
        return re.sub(r"\\(.)", r"\1", text[2])
    return value if re.fullmatch(r"-?\d+(?:\.\d+)?|true|false", value) else None


def members(s: Script, brace: int) -> list[tuple]:
    """Members of a type literal or interface: name, optional, type, doc, deprecated."""
    end, at, out = closing(s.code, brace), brace + 1, []
    while at < end:
        first = at + len(s.code[at:end]) - len(s.code[at:end].lstrip(" \n\t\r;,"))
        m = MEMBER.match(s.text, first) if first < end else None
        stop = end_of(s.code, m.end() if m else first, end, ";,\n")
        # a member runs on over line ends that no new member follows
        while stop < end and s.code[stop] == "\n" and (not NEXT.match(s.code[stop : end + 1]) or re.search(r"[|&:=?]\s*$", s.code[first:stop])):
            stop = end_of(s.code, stop + 1, end, ";,\n")
        if m:
            type_ = " ".join(without_comments(s, m.end(), stop).lstrip(":").split())
            out.append((m["q"] if m["q"] is not None else m["n"], m["o"] == "?" or None, type_, *doc(s.text[at:first])))
        at = max(stop, first) + 1
    return [{"name": n, "optional": bool(o), "type": t, "doc": d, "deprecated": x} for n, o, t, d, x in out]


def without_comments(s: Script, at: int, stop: int) -> str:
    return re.sub(r"//[^\n]*|/\*.*?\*/", " ", s.text[at:stop], flags=re.S) if re.search(r"/[/*]", s.text[at:stop]) else s.text[at:stop]


def split_type(s: Script, at: int, end: int, mark: str) -> list[tuple[int, int]]:
    """Places of the parts of a type around ``mark`` on the outermost level, without empty ones."""
    out = []
    while at <= end:
        stop = end_of(s.code, at, end, mark)
        if s.text[at:stop].strip():
            out.append((at, stop))
        at = stop + 1
    return out


def alias_end(s: Script, at: int) -> int:
    """End of the type that begins at ``at``: its semicolon, or the line end after which no operator goes on."""
    end = len(s.code)
    stop = end_of(s.code, at, end, ";\n")
    while stop < end and s.code[stop] == "\n" and (not s.code[at:stop].strip() or re.match(r"\s*[|&]", s.code[stop:]) or re.search(r"[|&=]\s*$", s.code[at:stop])):
        stop = end_of(s.code, stop + 1, end, ";\n")
    return stop


def types(s: Script, suffix: str) -> Iterator[tuple]:
    """Exported interfaces and aliases by the ending of their name, in order of their place."""
    found = []
    for m in INTERFACE.finditer(s.code):
        if m[1].endswith(suffix) and closing(s.code, m.end() - 1) > 0:
            # type parameters may have an extends of their own
            after = end_of(s.code, m.start(2), m.end(2), "e") if s.code[m.start(2)] == "<" else m.start(2)
            head = re.match(r"extends\s+(.*)", s.text[after : m.end(2)], re.S)
            bases = [" ".join(s.text[a:b].split()) for a, b in split_type(s, after + head.start(1), after + head.end(1), ",")] if head else []
            found.append((m.start(), m[1], bases, members(s, m.end() - 1)))
    for m in ALIAS.finditer(s.code):
        if m[1].endswith(suffix):
            bases, own = [], []
            for a, b in split_type(s, m.end(), alias_end(s, m.end()), "&"):
                brace = a + len(s.code[a:b]) - len(s.code[a:b].lstrip())
                if s.code[brace] == "{" and closing(s.code, brace) > 0:
                    own += members(s, brace)
                else:
                    bases.append(" ".join(s.text[a:b].split()))
            found.append((m.start(), m[1], bases, own))
    for at, name, bases, own in sorted(found, key=lambda x: x[0]):
        at += len(s.code[at:]) - len(s.code[at:].lstrip())
        yield at, name, bases, own, *doc(before(s, at))


def variant_sets(files: DataFrame) -> DataFrame:
    """Exported ``as const`` objects with their keys and literal values, and exported unions of two or more string
    literals. A key is deprecated by its doc comment, a union as a whole by its own."""
    def facts(s: Script):
        for m in VARIABLE.finditer(s.code):
            to = closing(s.code, m.end())
            if not m[1] or to < 0 or not AS_CONST.match(s.code, to + 1):
                continue
            rows = list(properties(s, m.end()))
            if rows:
                values = {name: v for _, name, _, a, b in rows if (v := plain(without_comments(s, a, b))) is not None}
                yield m.start(1), m[2], "constObject", [r[1] for r in rows], values, [r[1] for r in rows if doc(r[2])[1]]
        for m in ALIAS.finditer(s.code):
            parts = [LITERAL.fullmatch(without_comments(s, a, b).strip()) for a, b in split_type(s, m.end(), alias_end(s, m.end()), "|")]
            if len(parts) > 1 and all(parts):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                keys = [re.sub(r"\\(.)", r"\1", p[2]) for p in parts]
                yield at, m[1], "literalUnion", keys, {}, keys if doc(before(s, at))[1] else []

    return _each(files, VARIANT_SETS, facts)


def props_types(files: DataFrame) -> DataFrame:
    """Exported types whose name ends in ``Props``: what they extend, and their members."""
    return _each(files, TYPES, lambda s: types(s, PROPS))


def slot_sets(files: DataFrame) -> DataFrame:
    """Exported types whose name ends in ``Classes``: the slots of a component, and what they extend."""
    return _each(files, TYPES, lambda s: types(s, SLOTS))


def deprecated_paths(files: DataFrame, export: str) -> DataFrame:
    """Dotted paths of the objects in the variables named ``export`` that a comment on lines before them marks deprecated."""
    def facts(s: Script):
        open_ = [(m.end(), ()) for m in VARIABLE.finditer(s.code) if m[2] == export and closing(s.code, m.end()) > 0]
        found = []
        while open_:
            brace, path = open_.pop()
            for at, name, gap, start, stop in properties(s, brace):
                if "@deprecated" in gap.partition("\n")[2]:
                    found.append((at, ".".join((*path, name))))
                inner = start + len(s.code[start:stop]) - len(s.code[start:stop].lstrip())
                if inner < stop and s.code[inner] == "{" and closing(s.code, inner) > 0:
                    open_.append((inner, (*path, name)))
        yield from sorted(found)

    return _each(files, PATHS, facts)


def legal_values(props: DataFrame, sets: DataFrame) -> DataFrame:
    """(component, prop, legal): values of the props whose type is made of string literals and variant sets only.

    A set is named as a union (``Size``), by its keys (``keyof typeof Size``) or by its values (``(typeof
    Size)[keyof typeof Size]``); one of the prop's own file comes before one of the same name elsewhere, of those the
    least file. ``undefined`` and ``null`` add no value. Several types of one component are one: their values are united.
    """
    part = F.trim(F.regexp_replace("part", r"^\((.*)\)$", "$1"))
    kind = (
        F.when(part.isin("undefined", "null", ""), "none").when(part.rlike(r"""^(?:'[^']*'|"[^"]*")$"""), "literal").when(part.rlike(r"^keyof typeof [A-Za-z_$][A-Za-z0-9_$]*$"), "keys")
        .when(part.rlike(r"^\(?typeof ([A-Za-z_$][A-Za-z0-9_$]*)\)?\s*\[\s*keyof typeof \1\s*\]$"), "values").when(part.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), "union").otherwise("other"))
    name = F.when(kind == "keys", F.regexp_extract(part, r"([A-Za-z0-9_$]+)$", 1)).when(kind == "values", F.regexp_extract(part, r"typeof ([A-Za-z0-9_$]+)", 1)).when(kind == "union", part)
    rows = props.select("file", "ord", F.regexp_replace("name", PROPS + "$", "").alias("component"), F.explode("members").alias("m"))
    parts = rows.select("file", "ord", "component", F.col("m.name").alias("prop"), F.explode(F.split("m.type", r"\|")).alias("part"))
    parts = parts.select("file", "ord", "component", "prop", kind.alias("kind"), name.alias("set"), F.when(kind == "literal", F.substring(part, 2, F.length(part) - 2)).alias("text"))
    known = sets.select("file", F.col("name").alias("set"), F.struct("kind", "keys", F.map_values("values").alias("values")).alias("found"))
    own = cut(known.groupBy("file", "set").agg(F.first("found").alias("own")))  # scripts are scanned once for both look-ups
    any_ = own.groupBy("set").agg(F.min_by("own", "file").alias("any"))
    met = parts.join(sorted_join(own), ["file", "set"], "left").join(sorted_join(any_), "set", "left").withColumn("s", F.coalesce("own", "any"))
    values = (
        F.when(F.col("kind") == "literal", F.array("text")).when(F.col("kind") == "none", F.array().cast("array<string>"))
        .when((F.col("kind") == "union") & (F.col("s.kind") == "literalUnion"), F.col("s.keys")).when((F.col("kind") == "keys") & (F.col("s.kind") == "constObject"), F.col("s.keys"))
        .when((F.col("kind") == "values") & (F.col("s.kind") == "constObject") & (F.size("s.values") == F.size("s.keys")), F.col("s.values")))
    whole = met.withColumn("v", values).groupBy("file", "ord", "component", "prop").agg(F.bool_and(F.col("v").isNotNull()).alias("all"), F.flatten(F.collect_list("v")).alias("legal")).where("all and size(legal) > 0")
    return whole.select("component", "prop", F.explode("legal").alias("x")).groupBy("component", "prop").agg(F.array_sort(F.collect_set("x")).alias("legal"))
