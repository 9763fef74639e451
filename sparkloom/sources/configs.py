"""Compiler configurations, path aliases, the project root, and specifiers resolved to files."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.scratch import sorted_join

#: What a specifier may lack, in the order it is tried, and what marks a project's root.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
ROOT_MARKS = ["package.json", ".git"]


def read_jsonc(source: str) -> dict:
    """JSON with comments and trailing commas; strings are left as they are."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
    plain = token.sub(lambda m: m[0] if m[0][0] == '"' else "", source)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain))


def read_config(path: str) -> dict:
    """Compiler options along the chain of ``extends``; a child's option wins, a cycle or a missing file ends the chain."""
    chain, seen = [], set()
    while path and os.path.realpath(path) not in seen:
        seen.add(os.path.realpath(path))
        try:
            with open(path, encoding="utf-8") as file:
                found = read_jsonc(file.read())
        except (OSError, ValueError):
            break
        chain.append(found.get("compilerOptions", {}))
        parent = found.get("extends")
        path = os.path.join(os.path.dirname(path), parent if parent.endswith(".json") else parent + ".json") if isinstance(parent, str) else ""
    options: dict = {}
    for one in reversed(chain):
        options |= one
    return options


def aliases(options: dict, manifest: dict) -> dict[str, str]:
    """pattern -> target of compiler paths and package imports; the first source of a pattern wins."""
    base = options.get("baseUrl", ".")
    found = [(k, os.path.normpath(os.path.join(base, v[0]))) for k, v in options.get("paths", {}).items() if v]
    found += [(k, os.path.normpath(v)) for k, v in manifest.get("imports", {}).items() if isinstance(v, str)]
    out: dict[str, str] = {}
    for pattern, target in found:
        out.setdefault(pattern, target)
    return out


def project_root(start: str) -> str:
    """The nearest folder upwards with a manifest or a repository, else the start."""
    here = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(here, m)) for m in ROOT_MARKS):
            return here
        above = os.path.dirname(here)
        if above == here:
            return os.path.abspath(start)
        here = above


def resolve_modules(used: DataFrame, files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(file, specifier) with kind (file, package or unresolved) and target: the first candidate among ``files``.

    Relative specifiers are resolved from their file, aliases from the root; of aliases the longest pattern wins.
    """
    s = F.col("specifier")
    path = F.when(s.startswith("."), text.resolve_reference(F.col("file"), s))
    for pattern, target in sorted(patterns.items(), key=lambda x: -len(x[0])):
        head, star, _ = pattern.partition("*")
        hit = s.startswith(head) if star else s == pattern
        path = path.when(hit, F.concat(F.lit(target.partition("*")[0]), F.expr(f"substring(specifier, {len(head) + 1})")) if star else F.lit(target))
    rows = used.select("file", "specifier", path.alias("_path")).distinct()
    # a file stands under the two or three stems that some candidate leads to it from, instead of every path under all candidates
    stems = F.array_compact(F.array(*(
        F.when(F.col("file").endswith(c), F.struct(F.expr(f"substring(file, 1, length(file) - {len(c)})").alias("stem"), F.lit(at).alias("at"))) for at, c in enumerate(CANDIDATES))))
    known = files.select("file", F.explode(stems).alias("e")).groupBy(F.col("e.stem").alias("_path")).agg(F.min(F.struct("e.at", "file"))["file"].alias("_target"))
    joined = rows.join(sorted_join(known), "_path", "left")
    package = ~s.startswith(".") & F.col("_path").isNull()
    return joined.select("file", "specifier", F.when(F.col("_target").isNotNull(), "file").when(package, "package").otherwise("unresolved").alias("kind"), F.coalesce("_target", F.when(package, text.package_name(s))).alias("target"))
