"""Scripts to facts: imports, re-exports, elements, declarations, and styles in templates and objects.

No parser is used: a scanner blanks comments and strings out, then reads statements, tags with their attributes, and object
literals with balanced brackets. What it cannot read in a file becomes a limitation, never an error of the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.text import class_names
from sparkloom.schemas import DECLARATIONS, ELEMENTS, IMPORTS, LIMITATIONS, STYLE_VALUES
from sparkloom.sources import stylesheet

RE_EXPORTS = "file string, line int, column int, ord int, specifier string, names array<struct<exported:string,local:string,typeOnly:boolean>>, star boolean"
# Properties without a unit, makers of styles, and the longest signature.
UNITLESS = {"opacity", "z-index", "font-weight", "line-height", "flex", "flex-grow", "flex-shrink", "order", "zoom", "column-count", "fill-opacity", "stroke-opacity", "animation-iteration-count", "orphans", "widows", "tab-size", "grid-row", "grid-column"}
FACTORIES = {"makeStyles": "jss", "createStyles": "jss", "withStyles": "jss", "style": "vanilla-extract", "styleVariants": "vanilla-extract", "globalStyle": "vanilla-extract", "recipe": "vanilla-extract", "createTheme": "vanilla-extract", "createGlobalTheme": "vanilla-extract"}
SIGNATURE = 400

SKIPPED = re.compile(r"""(?<!:)//[^\n]*|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\\n])*"|(?<![A-Za-z0-9])'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
STATEMENT = re.compile(r"""(?m)^[ \t]*(import|export)\b(\s+type\b(?!\s+from\b|\s*,))?\s*([^;'"`()=]*?)\s*(?:\bfrom\s*)?(["'])([^"'\n]*)\4""")
TAG = re.compile(r"<(/?)([A-Za-z][\w.]*)?(?=[\s/>{])")
NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
DECLARED = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+([A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\s*\(|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=\s*(?:[\w.]+\s*(?:<[^>\n]*>)?\s*\(\s*)*(?:async\s*)?(?:function\s*)?\(|class\s+([A-Za-z_$][\w$]*))")
TEMPLATE = re.compile(r"\b(styled(?:\.\w+|\([^()]*\))(?:\.attrs\([^()]*\))?|css|keyframes|createGlobalStyle|injectGlobal)\s*(?:<[^>`]*>)?\s*`")
FACTORY = re.compile(r"\b(" + "|".join(FACTORIES) + r")\s*(?:<[^>()]*>)?\s*\(")
KEYS = re.compile(r"""(?:key|code)\s*===?\s*["']([^"']+)["']|case\s+["']([^"']+)["']""")
CLOSING = {"{": "}", "(": ")", "[": "]"}
BRACKETS, EQUALS, SPACE, FIRST_TEXT = re.compile(r"[{}()\[\]]"), re.compile(r"\s*=\s*"), re.compile(r"\s*"), re.compile(r">([^<{]*)")
AFTER_WORD = re.compile(r"\b(?:return|default|case|yield)$")


KEY = re.compile(r"""\s*,?\s*(?:(["'])(?P<q>[^"'\n]*)["']|(?P<n>[A-Za-z_$][\w$-]*)|\[[^\]]*\])\s*:\s*""")


def blank(text: str) -> str:
    """The text with comments and the inside of strings as spaces; line ends stay."""
    def empty(m: re.Match) -> str:
        x = m[0]
        inner = re.sub(r"[^\n]", " ", x)
        return inner if x[0] == "/" else x[0] + inner[1:-1] + x[-1] if len(x) > 1 else x
    return SKIPPED.sub(empty, text)


def closing(code: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; -1 if none does."""
    stack = []
    for m in BRACKETS.finditer(code, at):
        if m[0] in CLOSING:
            stack.append(CLOSING[m[0]])
        elif not stack or stack.pop() != m[0]:
            return -1
        if not stack:
            return m.start()
    return -1


class Script:
    """One file's facts."""

    def __init__(self, text: str):
        self.text, self.code = text, blank(text)
        self.ends = [m.end() for m in re.finditer("\n", text)]
        self.problems: list[tuple[int, str]] = []

    def place(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.ends, at)
        return line + 1, at - (self.ends[line - 1] if line else 0) + 1

    def statements(self) -> Iterator[tuple]:
        """(at, kind, type only, clause, specifier) of imports and re-exports."""
        for m in STATEMENT.finditer(self.text):
            word = m.start(1)
            if self.code[word : word + 6] == m[1] and (m[1] == "import" or "from" in m[0]):
                yield word, m[1], bool(m[2]), m[3].strip(), m[5]

    def elements(self) -> list[dict]:
        """Elements in order of their start, with attributes, handlers, keys, first text and whether a label is around."""
        out, open_ = [], []
        skip = 0
        for m in TAG.finditer(self.code):
            if m.start() < skip:
                continue
            if m[1]:
                name = m[2] or ""
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i] == name:
                        del open_[i:]
                        break
                continue
            last = m.start() - 1
            while last >= 0 and self.code[last].isspace():
                last -= 1
            before = self.code[last] if last >= 0 else ";"
            if m[2] is None or ((before.isalnum() or before in "_$)]") and not AFTER_WORD.search(self.code, max(0, last - 8), last + 1) and not open_):
                continue
            element = {"at": m.start(), "name": m[2], "props": {}, "expressions": {}, "lines": {}, "label": any(x in ("label", "Label") for x in open_)}
            at = m.end()
            while True:
                at = SPACE.match(self.code, at).end()
                c = self.code[at : at + 1]
                if c == "{":
                    end = closing(self.code, at)
                    if end < 0:
                        break
                    at = end + 1
                    continue
                key = NAME.match(self.code, at)
                if not key:
                    break
                at = key.end()
                value = EQUALS.match(self.code, at)
                if not value:
                    element["props"][key[0]] = "true"
                    continue
                at = value.end()
                quote = self.code[at : at + 1]
                if quote in "\"'" and quote:
                    end = self.code.find(quote, at + 1)
                    element["props"][key[0]] = self.text[at + 1 : end]
                elif quote == "{":
                    end = closing(self.code, at)
                    inner = self.text[at + 1 : end].strip()
                    plain = re.fullmatch(r"""(["'`])([^"'`$]*)\1|(-?[\d.]+|true|false)""", inner)
                    element["props"][key[0]] = (plain[2] if plain[3] is None else plain[3]) if plain else None
                    if not plain:
                        element["expressions"][key[0]] = inner
                else:
                    break
                if end < 0:
                    break
                at = end + 1
            rest = self.code[at : at + 2]
            if rest[:1] not in (">", "/"):
                self.problems.append((m.start(), "tag"))
                continue
            skip = at
            if rest[:1] == ">":
                text = FIRST_TEXT.match(self.text, at)
                element["text"] = text[1].strip() if text and text[1].strip() else None
                open_.append(m[2])
            else:
                element["text"] = None
            out.append(element)
        return out

    def declarations(self, elements: list[dict], styled: list[dict]) -> list[dict]:
        """Functions, constants and classes with the elements in their bodies: components and hooks."""
        out = []
        for m in DECLARED.finditer(self.code):
            name = m[1] or m[2] or m[3]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            body = m.end() if m[3] else closing(self.code, m.end() - 1)
            brace = self.code.find("{", max(body, 0))
            arrow = re.compile(r"\)\s*(?::[^={]*)?=>\s*\(").match(self.code, body) if body >= 0 and not m[3] else None
            end = closing(self.code, arrow.end() - 1) if arrow else closing(self.code, brace) if brace >= 0 else -1
            if body < 0 or end < 0:
                self.problems.append((start, "declaration"))
                continue
            inside = [e for e in elements if start <= e["at"] <= end]
            kind = "hook" if re.match(r"use[A-Z]", name) else "component" if name[0].isupper() and inside else None
            if kind is None:
                continue
            first = re.match(r"\s*\{([^}]*)\}", self.text[m.end() : body]) if not m[3] else None
            props = sorted({x for x in re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)", first[1])}) if first else []
            signature = re.findall(r"</?[A-Za-z][\w.]*|=>|[{}()\[\];,?:=+*/&|!<>-]|\b(?:return|if|else|for|while|const|let|await|switch|case|true|false|null)\b|[A-Za-z_$][\w$]*|\d+", self.code[start : end + 1])
            words = ["id" if re.fullmatch(r"[A-Za-z_$][\w$]*", x) and x not in ("return", "if", "else", "for", "while", "const", "let", "await", "switch", "case", "true", "false", "null") else x for x in signature]
            out.append({"at": start, "end": end, "name": name, "kind": kind, "props": props, "roles": sorted({e["props"]["role"] for e in inside if e["props"].get("role")}),
                        "aria": sorted({k for e in inside for k in e["props"] if k.startswith("aria-")}), "tags": sorted({e["name"] for e in inside if e["name"][0].islower()}),
                        "signature": words[:SIGNATURE], "count": len(inside), "css": sorted({s["property"] for s in styled if start <= s["at"] <= end})})
        return out

    def styles(self) -> list[dict]:
        """Declarations of styled templates and of style objects."""
        out = []
        for m in TEMPLATE.finditer(self.text):
            if not self.code[m.start() : m.start() + 3].strip():
                continue
            end = self._template_end(m.end())
            if end < 0:
                self.problems.append((m.start(), "template"))
                continue
            held: list[str] = []
            body = self._placeholders(self.text[m.end() : end], held)
            for line, column, prop, value, selector in stylesheet.scan("&{" + body + "}", "scss"):
                dynamic = "\x01" in value
                value = re.sub("\x01+", lambda x: "${" + held[0].strip() + "}" if len(held) == 1 else "${…}", value)
                at = m.end() + len("\n".join(body.split("\n")[: line - 1])) + (line > 1) + column - 1 - (2 if line == 1 else 0)
                out.append({"at": at, "property": prop, "value": value, "selector": selector, "source": "styled-components" if m[1].startswith(("styled", "create", "inject", "keyframes")) else "emotion", "dynamic": dynamic})
        for m in FACTORY.finditer(self.code):
            end = closing(self.code, m.end() - 1)
            brace = self.code.find("{", m.end(), end)
            if end > 0 <= brace:
                out += self._object(brace, None, FACTORIES[m[1]])
        for m in re.finditer(r"\b(style|sx)=\{\s*(?=\{)", self.code):
            out += self._object(m.end(), None, "inline-style")
        return sorted(out, key=lambda x: x["at"])

    def _template_end(self, at: int) -> int:
        depth = 0
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 1
            elif c == "`" and not depth:
                return at
            elif self.text.startswith("${", at):
                depth += 1
                at += 1
            elif c == "}" and depth:
                depth -= 1
            at += 1
        return -1

    @staticmethod
    def _placeholders(body: str, held: list[str]) -> str:
        """The body with each ${...} as marks of the same length, line ends kept."""
        out, at = [], 0
        while (start := body.find("${", at)) >= 0:
            depth, end = 1, start + 2
            while end < len(body) and depth:
                depth += (body[end] == "{") - (body[end] == "}")
                end += 1
            held.append(body[start + 2 : end - 1])
            out += [body[at:start], re.sub(r"[^\n]", "\x01", body[start:end])]
            at = end
        return "".join(out) + body[at:]

    def _object(self, brace: int, selector: str | None, source: str) -> list[dict]:
        """Declarations of an object literal: nested objects, of any depth, are selectors; a conditional gives both branches."""
        end = closing(self.code, brace)
        if end < 0:
            self.problems.append((brace, "object"))
            return []
        out, open_ = [], [(end, selector)]
        at = brace + 1
        while open_:
            end, selector = open_[-1]
            if at >= end:
                open_.pop()
                at = self._comma(end + 1, open_[-1][0]) + 1 if open_ else at
                continue
            key = KEY.match(self.text, at)
            if not key:
                at = self._comma(at, end) + 1
                continue
            name = key["q"] if key["q"] is not None else key["n"]
            start = key.end()
            if name is not None and self.code[start] == "{" and (inner := closing(self.code, start)) > 0:
                open_.append((inner, name if selector is None else f"{selector} {name}"))
                at = start + 1
                continue
            stop = self._comma(start, end)
            if name is not None:
                prop = self._property(name)
                for branch in self._branches(self.text[start:stop].strip()):
                    text, dynamic = self._value(branch, prop)
                    out.append({"at": key.start() + len(key[0]) - len(key[0].lstrip(" ,\n\t\r")), "property": prop, "value": text, "selector": selector, "source": source, "dynamic": dynamic})
            at = stop + 1
        return out

    def _comma(self, at: int, end: int) -> int:
        """The next comma on the same level, or the end."""
        while at < end:
            c = self.code[at]
            if c in CLOSING:
                to = closing(self.code, at)
                if to < 0:
                    return end
                at = to
            elif c == ",":
                return at
            at += 1
        return end

    @staticmethod
    def _property(key: str) -> str:
        if "-" in key:
            return key.lower()
        dashed = re.sub("([A-Z])", lambda m: "-" + m[1].lower(), key)
        return "-" + dashed if dashed.startswith("ms-") else dashed

    @staticmethod
    def _branches(value: str) -> list[str]:
        choice = re.fullmatch(r"[^?]+\?(?![?.])\s*(.+?)\s*:\s*(.+)", value, re.S)
        if choice:
            return [choice[1], choice[2]]
        return [re.split(r"\?\?|\|\|", value)[-1].strip()]

    @staticmethod
    def _value(value: str, prop: str) -> tuple[str, bool]:
        quoted = re.fullmatch(r"""(["'`])(.*)\1""", value, re.S)
        if quoted and "${" not in quoted[2]:
            return quoted[2], False
        if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", value):
            return (value if prop in UNITLESS or float(value) == 0 else value + "px"), False
        return value, True


def _each(files: DataFrame, schema: str, facts) -> DataFrame:
    """Rows of ``facts(script)`` for every readable file, with file and ord around them."""
    columns = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                try:
                    script = Script(bytes(content).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
                rows += [(file, *script.place(at), i, *rest) for i, (at, *rest) in enumerate(facts(script))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(run, schema)


def _names(clause: str) -> list[tuple[str, str, bool]]:
    inner = re.search(r"\{(.*)\}", clause, re.S)
    out = []
    for part in inner[1].split(",") if inner else []:
        m = re.fullmatch(r"\s*(type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*", part)
        if m:
            out.append((m[2], m[3] or m[2], bool(m[1])))
    return out


def imports(files: DataFrame) -> DataFrame:
    def facts(s: Script):
        for at, kind, type_only, clause, specifier in s.statements():
            if kind == "import":
                default = re.match(r"([A-Za-z_$][\w$]*)\s*(?:,|$)", clause)
                yield at, specifier, [dict(zip(("imported", "local", "typeOnly"), n, strict=True)) for n in _names(clause)], default[1] if default else None, type_only

    return _each(files, IMPORTS, facts)


def re_exports(files: DataFrame) -> DataFrame:
    def facts(s: Script):
        for at, kind, type_only, clause, specifier in s.statements():
            if kind == "export":
                yield at, specifier, [{"exported": b, "local": a, "typeOnly": t or type_only} for a, b, t in _names(clause)], clause.startswith("*")

    return _each(files, RE_EXPORTS, facts)


def elements(files: DataFrame) -> DataFrame:
    def facts(s: Script):
        for e in s.elements():
            handlers = sorted(k for k in {*e["props"], *e["expressions"]} if re.match(r"on[A-Z]", k))
            keys = sorted({a or b for k, x in e["expressions"].items() if k.startswith("onKey") for a, b in KEYS.findall(x)})
            yield e["at"], e["name"], None, None, {k: v for k, v in e["props"].items() if v is not None}, e["expressions"], handlers, keys, e["text"], e["label"]

    return _each(files, ELEMENTS, facts)


def declarations(files: DataFrame) -> DataFrame:
    def facts(s: Script):
        for d in s.declarations(s.elements(), s.styles()):
            yield d["at"], d["name"], d["kind"], d["props"], d["roles"], d["aria"], d["tags"], d["signature"], d["count"], 0, [], d["css"]

    return _each(files, DECLARATIONS, facts)


def style_values(files: DataFrame) -> DataFrame:
    """The style_values table of scripts: styled templates, style factories, inline style objects."""
    def facts(s: Script):
        for x in s.styles():
            yield x["at"], x["property"], x["value"], x["source"], x["selector"], x["dynamic"]

    rows = _each(files, "file string, line int, column int, ord int, property string, authored string, source string, selector string, dynamic boolean", facts)
    mark = r"(?i)\s*!\s*important\s*$"
    return rows.select(
        "file", "line", "column", "ord", "property", F.regexp_replace("authored", mark, "").alias("value"), "authored", "source", "selector", F.coalesce(class_names(F.col("selector")), F.array().cast("array<string>")).alias("classNames"),
        F.col("authored").rlike(mark).alias("important"), "dynamic", F.lit(None).cast("struct<kind:string,name:string,slot:string>").alias("appliedTo")).to(StructType.fromDDL(STYLE_VALUES))


def limitations(files: DataFrame) -> DataFrame:
    """What the scanner met and could not read."""
    def facts(s: Script):
        s.declarations(s.elements(), s.styles())
        for at, what in sorted(s.problems):
            yield at, "unsupported-syntax", what

    rows = _each(files, "file string, line int, column int, ord int, reason string, detail string", facts)
    return rows.select("file", "line", "reason", "detail").to(StructType.fromDDL(LIMITATIONS))


def classify(elements_: DataFrame, imports_: DataFrame, kit_packages: DataFrame) -> DataFrame:
    """Elements with resolvedFrom and kitComponent: the root of a dotted name is looked up among the file's bindings, the
    first binding of a name wins; it is a component of the dictionary if its package is one of the dictionary's."""
    named = imports_.select("file", "ord", "specifier", F.explode("names").alias("n")).select("file", "ord", "specifier", F.col("n.local").alias("_root"), F.col("n.imported").alias("_imported"))
    default = imports_.where("defaultImport is not null").select("file", "ord", "specifier", F.col("defaultImport").alias("_root"), F.lit("default").alias("_imported"))
    first = named.unionByName(default).groupBy("file", "_root").agg(F.min(F.struct("ord", "specifier", "_imported")).alias("_b"))
    kit = kit_packages.select(F.col("package").alias("_package")).distinct()
    from sparkloom.functions.text import package_name

    rows = elements_.withColumn("_root", F.split("name", r"\.")[0]).join(first, ["file", "_root"], "left")
    rows = rows.withColumn("resolvedFrom", F.col("_b.specifier")).join(kit, package_name(F.col("_b.specifier")) == F.col("_package"), "left")
    name = F.when(F.col("_b._imported") == "default", F.col("_root")).otherwise(F.col("_b._imported"))
    return rows.withColumn("kitComponent", F.when(F.col("_package").isNotNull(), name)).select(*elements_.columns)
