"""Extracted dictionaries on disk: several member tables, published together and read all or nothing.

A publication writes all members into a new folder and then one small numbered entry that names it. The entry is created
only if that number is not taken, so of two writers one gets the next number; readers take the last whole entry and thus
see all members of one publication or those of the one before, never half of one. Folders are never changed once named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTRIES, STAMP, CORRUPT = "_published", "_stamp.json", "_corrupt"


@dataclass
class Corpus:
    """Members by name, where they come from, and why a publication that is there was not used."""

    members: dict[str, DataFrame]
    provenance: dict[str, str | None]
    warnings: list[dict[str, str | None]] = field(default_factory=list)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; false if there is one of that name."""
    fs, p = _files(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as e:  # another writer was first
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def _entries(spark: SparkSession, home: str) -> list[str]:
    fs, p = _files(spark, f"{home}/{ENTRIES}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def write_corpus(spark: SparkSession, root: str, kit: str, members: dict[str, DataFrame], version: str | None, commit: str | None, extracted_at: str) -> str:
    """Publishes the members (name -> frame) of a kit; returns their folder. Rows are counted while they are written."""
    home = f"{root.rstrip('/')}/{kit}"
    folder = f"{home}/v-{uuid.uuid4().hex}"
    sizes = {}
    for name, rows in members.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "gzip").json(f"{folder}/{name}")
        sizes[name] = {"rows": seen.get["n"], "schema": rows.schema.jsonValue()}
    stamp = {"kit": kit, "version": version, "commit": commit, "extractedAt": extracted_at, "members": sizes}
    _put(spark, f"{folder}/{STAMP}", json.dumps(stamp) + "\n")
    number = int(([*_entries(spark, home)] or ["0"])[-1]) + 1
    while not _put(spark, f"{home}/{ENTRIES}/{number:012d}", folder.rsplit("/", 1)[1] + "\n"):
        number += 1
    return folder


def _published(spark: SparkSession, home: str) -> str | None:
    """Folder of the last entry that was written whole; a writer that died in between left one without its line end."""
    for number in reversed(_entries(spark, home)):
        text = _get(spark, f"{home}/{ENTRIES}/{number}")
        if text and text.endswith("\n"):
            return f"{home}/{text.strip()}"
    return None


def _missing(declared: StructType, written: StructType) -> str | None:
    """The first declared column that the written schema lacks or has in another type, whatever may be null in it; more
    columns may be there."""
    have = {f.name: f.dataType.simpleString() for f in written}
    bad = [f.name for f in declared if have.get(f.name) != f.dataType.simpleString()]
    return f"{bad[0]}: not there as {declared[bad[0]].dataType.simpleString()}" if bad else None


def _member(spark: SparkSession, folder: str, name: str, stamp: dict, declared: str, required: list[str]) -> tuple[DataFrame | None, dict | None]:
    path = f"{folder}/{name}"
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return None, {"reason": "incomplete", "file": path, "detail": None}
    invalid = lambda detail: (None, {"reason": "invalid", "file": path, "detail": detail})
    told = stamp.get("members", {}).get(name)
    if told is None:
        return invalid("no stamp")
    written = StructType.fromJson(told["schema"])
    lack = _missing(StructType.fromDDL(declared), written)
    if lack:
        return invalid(lack)
    rows = spark.read.schema(StructType([*written.fields, StructField(CORRUPT, StringType())])).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    whole = rows.select(*(F.col(f"`{f.name}`") for f in written), CORRUPT)
    # every column is counted, as the reader checks only those that a query asks for
    filled = [F.count(F.col(f"`{f.name}`")).alias(f"_{f.name}") for f in written]
    try:
        found = whole.agg(F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("bad"), *filled).first()
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError) as e:  # a file that cannot be read at all, such as a broken archive
        return invalid(f"unreadable: {type(e).__name__}")
    if found["bad"]:
        return invalid(f"{found['bad']} rows do not fit the schema")
    if found["n"] != told["rows"]:
        return invalid(f"{found['n']} rows instead of {told['rows']}")
    nulls = [c for c in required if found[f"_{c}"] < found["n"]]
    return (None, {"reason": "invalid", "file": path, "detail": f"{nulls[0]}: null"}) if nulls else (whole.drop(CORRUPT), None)


def read_corpus(spark: SparkSession, root: str, kit: str, schemas: dict[str, str], required: dict[str, list[str]], fallback: dict[str, DataFrame], fallback_version: str | None = None) -> Corpus:
    """The members of the last publication, or ``fallback`` whole with a warning for every member that is missing or bad.

    ``schemas`` has the columns (DDL) that each member must have, ``required`` those that must not be null. Further
    columns that a later version wrote are kept. Without any publication the fallback is taken and nothing is said.
    """
    home = f"{root.rstrip('/')}/{kit}"
    embedded = {"kind": "embedded", "version": fallback_version, "commit": None, "extractedAt": None}
    folder = _published(spark, home)
    if folder is None:
        return Corpus(fallback, embedded)
    try:
        stamp = json.loads(_get(spark, f"{folder}/{STAMP}") or "null")
    except ValueError:
        stamp = None
    if not isinstance(stamp, dict) or stamp.get("kit") != kit:
        detail = "no stamp" if not isinstance(stamp, dict) else f"stamp of {stamp.get('kit')}"
        return Corpus(fallback, embedded, [{"reason": "invalid", "file": f"{folder}/{STAMP}", "detail": detail}])
    read = {name: _member(spark, folder, name, stamp, schemas[name], required.get(name, [])) for name in schemas}
    warnings = [w for _, w in read.values() if w]
    if warnings:
        return Corpus(fallback, embedded, warnings)
    return Corpus({n: rows for n, (rows, _) in read.items()}, {"kind": "updated", **{k: stamp.get(k) for k in ("version", "commit", "extractedAt")}})
