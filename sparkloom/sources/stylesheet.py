"""Stylesheets to style_values: a left-to-right scanner over whole files, one Arrow batch at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.text import class_names
from sparkloom.schemas import STYLE_VALUES

#: Working columns of the scanner; style_values derives the rest of the fact table.
COLUMNS = "file string, line int, column int, ord int, property string, authored string, source string, selector string"
TOKEN = re.compile(r"""/\*.*?(?:\*/|$)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{};()]""", re.S)
LINE_COMMENT = re.compile(r"(?<![:\w])//[^\n]*")


def scan(text: str, source: str = "css") -> list[tuple]:
    """(line, column, property, value as written, selector) of every declaration; nested selectors are joined by spaces.

    Variables ($x, --x, @x) are no style values; at-rules only nest.
    """
    if source != "css":
        text = LINE_COMMENT.sub(lambda m: " " * len(m[0]), text)
    out, stack, start, paren = [], [], 0, 0
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def blank(part: str) -> str:
        return re.sub(r"/\*.*?(?:\*/|$)", lambda m: re.sub(r"[^\n]", " ", m[0]), part, flags=re.S)

    def declare(end: int) -> None:
        raw = blank(text[start:end])
        name, colon, value = raw.partition(":")
        prop = name.strip()
        if not colon or not stack or not re.fullmatch(r"-?[A-Za-z][A-Za-z-]*", prop):
            return
        at = start + len(name) - len(name.lstrip())
        line = bisect_right(starts, at) - 1
        value = value.strip()
        selector = " ".join(s for s in stack if not s.startswith("@"))
        out.append((line + 1, at - starts[line] + 1, prop.lower(), value, selector))

    for m in TOKEN.finditer(text):
        c = m[0]
        if c == "{":
            stack.append(" ".join(blank(text[start : m.start()]).split()))
        elif c == "}":
            declare(m.start())
            if stack:
                stack.pop()
        elif c == ";":
            if paren > 0:
                continue  # inside url(data:...;...)
            declare(m.start())
        elif c in "()":
            paren += 1 if c == "(" else -1
            continue
        else:
            continue
        start, paren = m.end(), 0
    return out


def style_values(files: DataFrame) -> DataFrame:
    """The style_values table of (file, content) rows; a file that cannot be decoded gives none (see :func:`unreadable`).

    Values of stylesheets are static and linked to no element yet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                kind = file.rpartition(".")[2].lower()
                try:
                    text = bytes(content).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                rows += [(file, line, column, i, p, v, kind, s) for i, (line, column, p, v, s) in enumerate(scan(text, kind))]
            yield pd.DataFrame(rows, columns=["file", "line", "column", "ord", "property", "authored", "source", "selector"])

    mark = r"(?i)\s*!\s*important\s*$"
    return files.select("file", "content").mapInPandas(run, COLUMNS).select(
        "file", "line", "column", "ord", "property", F.regexp_replace("authored", mark, "").alias("value"), "authored", "source", "selector", class_names(F.col("selector")).alias("classNames"),
        F.col("authored").rlike(mark).alias("important"), F.lit(False).cast("boolean").alias("dynamic"), F.lit(None).cast("struct<kind:string,name:string,slot:string>").alias("appliedTo")).to(StructType.fromDDL(STYLE_VALUES))


def unreadable(files: DataFrame) -> DataFrame:
    """Limitations for files whose content is no UTF-8."""
    bad = F.try_validate_utf8(F.col("content").cast("string")).isNull()
    return files.where(bad).select("file", F.lit(None).cast("int").alias("line"), F.lit("unreadable-file").alias("reason"), F.lit("not UTF-8").alias("detail"))
