"""Variables of stylesheets across files: declarations, module links, and values with their root cause.

Chains are resolved from the literals upwards: a declaration is settled once all it refers to is, one join a round, so
shared tails are followed once for all that use them. What is not settled after eight rounds is a cycle, deeper than any
real stylesheet, or refers to something unknown. Declarations are joined by sorting, never by broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import resolve_reference
from sparkloom.scratch import cut, drop_cut, sorted_join

HOPS = 8
DECLARED = re.compile(r"^[ \t]*\$([\w-]+)\s*:\s*([^;]+?)\s*(?:!default|!global)?\s*;", re.M)
USED = re.compile(r"""@(?:use|forward)\s+['"]([^'"]+)['"](?:\s+as\s+([\w*]+))?""")
IMPORTED = re.compile(r"""@import\s+((?:['"][^'"]+['"]\s*,?\s*)+);""")
QUOTED = re.compile(r"""['"]([^'"]+)['"]""")
REFERENCE = r"(?:([A-Za-z0-9_-]+)\.)?\$([A-Za-z0-9_-]+)"
#: Fixed value: where an import is looked for, in order; {} is the folder, [] the last part of the name.
CANDIDATES = ["{}[]", "{}[].scss", "{}[].sass", "{}[].css", "{}_[].scss", "{}_[].sass", "{}[]/_index.scss", "{}[]/index.scss"]


def scan(text: str) -> Iterator[tuple]:
    """(kind, ord, line, name, value) of a stylesheet: variables, the last of one name wins, then links in reading order.

    A link's name is its namespace, null where names come in bare.
    """
    ends = [m.end() for m in re.finditer("\n", text)]
    last = {m[1]: m for m in DECLARED.finditer(text)}
    for m in last.values():
        yield "variable", m.start(), bisect_right(ends, m.start()) + 1, m[1], m[2]
    links = [(0, m.start(), None if m[2] in (None, "*") else m[2], m[1]) for m in USED.finditer(text)]
    links += [(1, m.start(1) + q.start(), None, q[1]) for m in IMPORTED.finditer(text) for q in QUOTED.finditer(m[1])]
    for k, (_, at, name, specifier) in enumerate(sorted(links)):
        yield "link", k, bisect_right(ends, at) + 1, name, specifier


def _facts(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *fact) for file, content in zip(batch["file"], batch["content"], strict=True) for fact in scan(bytes(content).decode("utf-8", "replace") if content is not None else "")]
            yield pd.DataFrame(rows, columns=["file", "kind", "ord", "line", "name", "value"])

    return files.select("file", "content").mapInPandas(run, "file string, kind string, ord long, line int, name string, value string")


def _sources(links: DataFrame, files: DataFrame) -> DataFrame:
    """(file, namespace, ord, target) of the links whose stylesheet is among the files; built-in and package ones are not."""
    inside = links.where(~F.col("value").rlike("^(sass:|~|@)"))
    path = resolve_reference(F.col("file"), F.concat(F.lit("./"), F.col("value")))
    rows = inside.select("file", "name", "ord", path.alias("path")).withColumn("_folder", F.regexp_extract("path", "^(.*/)?", 0)).withColumn("_last", F.regexp_extract("path", "([^/]*)$", 1))
    tried = [F.replace(F.replace(F.lit(c), F.lit("{}"), F.col("_folder")), F.lit("[]"), F.col("_last")) for c in CANDIDATES]
    asked = rows.select("file", "name", "ord", F.posexplode(F.array(*tried)).alias("_at", "target"))
    found = asked.join(files.select(F.col("file").alias("target")).distinct(), "target").groupBy("file", "name", "ord").agg(F.min_by("target", "_at").alias("target"))
    named = found.where("name is not null").groupBy("file", "name").agg(F.max_by("target", "ord").alias("target"), F.max("ord").alias("ord"))  # the last link of a namespace wins
    return found.where("name is null").unionByName(named, allowMissingColumns=True).select("file", F.col("name").alias("namespace"), "ord", "target")


def references(value: Column) -> Column:
    """array<struct<namespace, name>> of the variables in a value, in order; namespace null where there is none."""
    return F.transform(F.arrays_zip(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(1)).alias("a"), F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(2)).alias("b")),
                       lambda x: F.struct(F.nullif(x["a"], F.lit("")).alias("namespace"), x["b"].alias("name")))


def _looked_up(asked: DataFrame, variables: DataFrame, sources: DataFrame) -> DataFrame:
    """Asked (file, namespace, name) with the declaration (to_file) they mean: the file's own, else of the first bare link that
    has one; with a namespace that link's alone."""
    own = variables.select("file", "name", F.col("file").alias("to_file"))
    bare = asked.where("namespace is null")
    near = bare.join(sorted_join(own), ["file", "name"]).select("file", "name", F.lit(-1).cast("long").alias("ord"), "to_file")
    there = variables.select(F.col("file").alias("target"), "name")
    far = bare.join(sources.where("namespace is null").drop("namespace"), "file").join(sorted_join(there), ["target", "name"]).select("file", "name", "ord", F.col("target").alias("to_file"))
    first = near.unionByName(far).groupBy("file", "name").agg(F.min_by("to_file", "ord").alias("to_file")).select("file", F.lit(None).cast("string").alias("namespace"), "name", "to_file")
    named = asked.where("namespace is not null").join(sources.where("namespace is not null").drop("ord"), ["file", "namespace"]).join(sorted_join(there), ["target", "name"])
    return first.unionByName(named.select("file", "namespace", "name", F.col("target").alias("to_file")))


def _filled(value: Column, parts: Column) -> Column:
    """The value with its references replaced by ``parts``, in order."""
    plain = F.split(value, REFERENCE, -1)
    return F.concat(plain[0], F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.element_at(parts, i), F.get(plain, i))), ""))


def _referring(rows: DataFrame, meant: DataFrame) -> DataFrame:
    """One row for each reference of rows (key, file, value): key, pos, to_file and name (to_file null if it means nothing)."""
    each = rows.select("key", "file", F.posexplode(references(F.col("value"))).alias("pos", "r")).select("key", "file", "pos", "r.namespace", "r.name").alias("e")
    m = sorted_join(meant).alias("m")
    same = (F.col("e.file") == F.col("m.file")) & F.col("e.namespace").eqNullSafe(F.col("m.namespace")) & (F.col("e.name") == F.col("m.name"))
    return each.join(m, same, "left").select("e.key", "e.pos", "m.to_file", "e.name")


def _settled(rows: DataFrame, referring: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (key, value) all of whose references are resolved: key, resolved value, and root of the last reference."""
    r = resolved.select(F.col("file").alias("to_file"), "name", "resolved", "root")
    met = referring.join(sorted_join(r), ["to_file", "name"], "left").groupBy("key").agg(
        F.count("*").alias("n"), F.count("resolved").alias("m"), F.array_sort(F.collect_list(F.struct("pos", "resolved", "root"))).alias("parts")).where("n = m")
    return rows.join(sorted_join(met), "key").select("key", _filled(F.col("value"), F.transform("parts", lambda p: p["resolved"])).alias("resolved"), F.element_at("parts", -1)["root"].alias("root"))


def variables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations (file, name, line, value, resolved, root) of all stylesheets, and their links.

    ``root`` (file, line, name) is the deepest declaration of the chain, the one line whose repair mends every use; of a
    value with several variables, of the last one. Both are null where the chain ends at nothing, in a circle or too deep.
    """
    facts = cut(_facts(files))
    declared = facts.where("kind = 'variable'").select("file", "name", "line", "value", F.struct("file", "name").alias("key"))
    sources = cut(_sources(facts.where("kind = 'link'"), files))
    asked = declared.select("file", F.explode(references(F.col("value"))).alias("r")).select("file", "r.namespace", "r.name").distinct()
    referring = cut(_referring(declared, _looked_up(asked, declared, sources)))
    plain = declared.where(F.size(references(F.col("value"))) == 0)
    known = cut(plain.select("file", "name", F.col("value").alias("resolved"), F.struct("file", "line", "name").alias("root")))
    for _ in range(1, HOPS):
        open_ = declared.join(sorted_join(known.select("file", "name")), ["file", "name"], "left_anti")
        more = _settled(open_, referring.join(sorted_join(open_.select("key")), "key"), known).select("key.file", "key.name", "resolved", "root")
        before, known = known, cut(known.unionByName(more))
        grown = known.count() > before.count()
        drop_cut(before)
        if not grown:
            break
    return declared.drop("key").join(sorted_join(known), ["file", "name"], "left"), sources


def resolve_values(style_values: DataFrame, files: DataFrame) -> DataFrame:
    """Style values with ``value`` resolved, rootCause (file, line, name) and unresolved.

    Values without a variable keep theirs, with no root cause; values that cannot be resolved keep the text as written.
    """
    declared, sources = variables(files)
    rows = style_values.select("file", "value").where(F.size(references(F.col("value"))) > 0).distinct().withColumn("key", F.struct("file", "value"))
    asked = rows.select("file", F.explode(references(F.col("value"))).alias("r")).select("file", "r.namespace", "r.name").distinct()
    done = _settled(rows, _referring(rows, _looked_up(asked, declared.select("file", "name"), sources)), declared.where("resolved is not null").select("file", "name", "resolved", "root"))
    done = done.select("key.file", "key.value", "resolved", F.col("root").alias("rootCause"))
    joined = style_values.join(done, ["file", "value"], "left")
    open_ = (F.size(references(F.col("value"))) > 0) & F.col("resolved").isNull()
    return joined.select(*(F.coalesce("resolved", "value").alias("value") if c == "value" else F.col(c) for c in style_values.columns), "rootCause", open_.alias("unresolved"))
