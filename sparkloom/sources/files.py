"""Project files as a table: recursive listing, extensions, ignore patterns, scope, size cap, lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scanned extensions, the largest scanned file, patterns that are always ignored.
CODE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
STYLE_EXTENSIONS = ["css", "scss", "sass", "less", "styl"]
SIZE_CAP = 1024 * 1024
IGNORED = [
    "node_modules/", ".git/", ".hg/", ".svn/", "dist/", "build/", "out/", "coverage/", ".next/", ".nuxt/", ".svelte-kit/", ".turbo/", ".cache/", ".parcel-cache/", ".yarn/", "storybook-static/", "ui-analyzer/",
    "*.min.js", "*.min.css", "*.d.ts", "*.snap"]
IGNORE_FILES = [".gitignore", ".dsignore"]


def ignore_expression(pattern: str) -> str:
    """Java regular expression of one gitignore pattern over a path relative to the root."""
    folder, anchored = pattern.endswith("/"), "/" in pattern.strip("/")
    body = pattern.strip("/")
    out = ""
    i = 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored or pattern.startswith("/") else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path, patterns: list[tuple[str, str]]):
    """Whether patterns (folder, pattern) leave a path out; a pattern holds below its folder, later ones win, ! takes back."""
    verdict = F.lit(False)
    for folder, p in patterns:
        below = F.expr(f"substring(`{path}`, {len(folder) + 2 if folder else 1})")
        hit = below.rlike(ignore_expression(p.lstrip("!")))
        if folder:
            hit = hit & F.col(path).startswith(folder + "/")
        verdict = F.when(hit, F.lit(not p.startswith("!"))).otherwise(verdict)
    return verdict


def ignore_patterns(every: DataFrame) -> list[tuple[str, str]]:
    """(folder, pattern) of all ignore files among (file, content), outer folders first; such files are few and small."""
    rows = every.where(F.regexp_extract("file", r"([^/]*)$", 1).isin(IGNORE_FILES)).select("file", F.decode("content", "utf-8").alias("text")).collect()
    out = []
    for file, text in sorted(map(tuple, rows), key=lambda r: (r[0].count("/"), r[0].rpartition("/")[0], IGNORE_FILES.index(r[0].rpartition("/")[2]))):
        lines = (x.strip() for x in text.splitlines())
        out += [(file.rpartition("/")[0], x) for x in lines if x and not x.startswith("#")]
    return out


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, length, content) of what Spark's listing leaves out: ignore files, and code and styles below names with . or _.

    The driver lists the root through the file system that Spark uses, and reads these few small files.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    prefix = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    wanted = re.compile(r"(?i)\.(" + "|".join(CODE_EXTENSIONS + STYLE_EXTENSIONS) + ")$")
    never = re.compile("|".join(ignore_expression(p) for p in IGNORED))
    rows, listed = [], fs.listFiles(top, True)
    while listed.hasNext():
        status = listed.next()
        file = status.getPath().toUri().getPath().removeprefix(prefix)
        name = file.rpartition("/")[2]
        if never.search(file) or not (name in IGNORE_FILES or (wanted.search(name) and any(x[0] in "._" for x in file.split("/")))):
            continue
        content = b""
        if status.getLen() <= SIZE_CAP:
            stream = fs.open(status.getPath())
            content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
        rows.append((file, status.getLen(), content))
    return spark.createDataFrame(rows, "file string, length long, content binary")


def list_files(spark: SparkSession, root: str, patterns: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """file (relative), length, content of all code and style files below root that no pattern leaves out.

    Patterns are the built-in ones, those of ignore files, then the caller's. ``scope`` is a file or folder of the root.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split(":", 1)[-1]) + "/+", "")
    rows = raw.select(relative.alias("file"), "length", "content").unionByName(hidden_files(spark, root))
    outside = ~ignored("file", [("", p) for p in IGNORED])
    layered = ignored("file", [*ignore_patterns(rows.where(outside)), *(("", p) for p in patterns or [])])
    kept = rows.where(F.lower("file").rlike(r"\.(" + "|".join(CODE_EXTENSIONS + STYLE_EXTENSIONS) + ")$") & outside & ~layered)
    return kept.where((F.col("file") == scope) | F.col("file").startswith(scope.rstrip("/") + "/")) if scope else kept


def split_by_size(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable files, and limitations for those over the size cap (whose content is never read)."""
    large = files.where(F.col("length") > SIZE_CAP).select("file", F.lit(None).cast("int").alias("line"), F.lit("file-too-large").alias("reason"), F.col("length").cast("string").alias("detail"))
    return files.where(F.col("length") <= SIZE_CAP), large


def source_lines(files: DataFrame) -> DataFrame:
    """file, line, text: split on line ends, without a last empty line."""
    lines = F.split(F.decode("content", "utf-8"), "\r?\n", -1)
    cut = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return files.select("file", F.posexplode(cut).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """name and the merged dependency map of package manifests."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    schema = "name string, " + ", ".join(f"{k} map<string,string>" for k in kinds)
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    entries = reduce(lambda a, b: F.concat(a, b), [F.coalesce(F.map_entries(k), F.array().cast("array<struct<key:string,value:string>>")) for k in kinds])
    first = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda a, e: F.when(F.map_contains_key(a, e["key"]), a).otherwise(F.map_concat(a, F.create_map(e["key"], e["value"]))))
    return m.select("name", first.alias("dependencies"))
