"""Publications that are whole, half written or bad; findings and limitations from one job."""

import glob
import gzip
import os

from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.plans import rules
from sparkloom.sources import corpus

SCHEMAS = {"a": "id bigint, name string", "b": "tags array<string>"}


def test_publications(spark, tmp_path):
    root, need = str(tmp_path), {"a": ["id"]}
    a = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "id bigint, name string, later double")
    b = spark.createDataFrame([(["t", None],)], "tags array<string>")
    own = {"a": a.limit(0), "b": b.limit(0)}
    read = lambda: corpus.read_corpus(spark, root, "k", SCHEMAS, need, own, "built in")

    got = read()
    assert got.members is own and got.provenance["kind"] == "embedded" and got.provenance["version"] == "built in" and not got.warnings
    first = corpus.write_corpus(spark, root, "k", {"a": a, "b": b}, "1", "c0ffee", "2024-01-01")
    got = read()
    assert got.provenance == {"kind": "updated", "version": "1", "commit": "c0ffee", "extractedAt": "2024-01-01"} and not got.warnings
    assert sorted(map(tuple, got.members["a"].collect())) == [(1, "x", 2.5), (2, None, None)] and got.members["b"].first().tags == ["t", None]

    # a folder without an entry, and an entry whose writer died, are not seen
    a.write.json(f"{root}/k/v-half/a")
    with open(f"{root}/k/_published/{2:012d}", "w") as f:
        f.write("v-ha")
    assert read().provenance["version"] == "1"
    corpus.write_corpus(spark, root, "k", {"a": a.limit(0), "b": b}, "2", None, "2024-01-02")
    assert read().provenance["version"] == "2" and read().members["a"].count() == 0
    assert f"{3:012d}" in os.listdir(f"{root}/k/_published")
    # frames of the publication before can still be read
    assert got.members["a"].count() == 2 and os.path.isdir(first)

    bad = [
        ({"a": a.withColumn("id", F.lit("1")), "b": b}, {"a": "id: not there as bigint"}), ({"a": a.drop("name"), "b": b.select(F.lit(1).alias("tags"))}, {"a": "name: not there as string", "b": "tags: not there as array<string>"}),
        ({"a": a.withColumn("id", F.when(F.col("id") == 1, 1).cast("bigint")), "b": b}, {"a": "id: null"}), ({"b": b}, {"a": None})]
    for members, want in bad:
        corpus.write_corpus(spark, root, "k", members, "bad", None, "2024-01-03")
        got = read()
        assert got.members is own and {w["file"].rsplit("/", 1)[1]: w["detail"] for w in got.warnings} == want
        assert [w["reason"] for w in got.warnings] == ["incomplete" if d is None else "invalid" for d in want.values()]


def test_damaged_members(spark, tmp_path):
    root = str(tmp_path)
    a = spark.range(20).select(F.col("id"), F.lit("n").alias("name"))
    b = spark.range(1).select(F.array(F.lit("t")).alias("tags"))  # never null, unlike the declared list
    read = lambda kit: corpus.read_corpus(spark, root, kit, SCHEMAS, {}, {"a": a.limit(0), "b": b})
    damage = {
        "type": (lambda: gzip.compress(b'{"id":"no","name":"n"}\n'), "rows do not fit"), "text": (lambda: gzip.compress(b'{"id":1,\n'), "rows do not fit"),
        "fewer": (lambda: gzip.compress(b'{"id":1,"name":"n"}\n'), "rows instead of 20"), "archive": (lambda: b"\x1f\x8bnot an archive", "unreadable")}
    for kit, (data, detail) in damage.items():
        folder = corpus.write_corpus(spark, root, kit, {"a": a.coalesce(1), "b": b}, None, None, "2024-01-01")
        file = glob.glob(f"{folder}/a/part-*.gz")[0]
        with open(file, "wb") as f:
            f.write(data())
        for crc in glob.glob(f"{folder}/a/.part-*.crc"):
            os.remove(crc)
        got = read(kit)
        assert [w["reason"] for w in got.warnings] == ["invalid"] and detail in got.warnings[0]["detail"], (kit, got.warnings)
        assert got.members["a"].count() == 0
    folder = corpus.write_corpus(spark, root, "other", {"a": a, "b": b}, None, None, "2024-01-01")
    os.rename(f"{root}/other", f"{root}/moved")
    assert read("moved").warnings[0]["detail"] == "stamp of other"


def test_two_outputs_of_rules(spark):
    style = spark.createDataFrame([("a.ts", 1, 1, 1, "outline", "none", "x", "jss"), ("a.css", 2, 1, 2, "outline", "none", ".b", "css"), ("a.ts", 1, 9, 3, "outline", "none", "x", "jss")], "file string, line int, column int, ord int, property string, value string, selector string, source string")
    rows = style.withColumn("authored", F.col("value")).withColumn("classNames", F.array().cast("array<string>")).withColumn("important", F.lit(False)).withColumn("dynamic", F.lit(False))
    rows = rows.withColumn("appliedTo", F.lit(None).cast("struct<kind:string,name:string,slot:string>"))
    imports = spark.createDataFrame([], schemas.IMPORTS)
    tables = rules.Tables(style_values=rows, imports=imports)
    found, limited = rules.check(tables)
    assert [(r.file, r.line) for r in found.where("rule = 'a11y.focus.suppressed'").collect()] == [("a.css", 2)]
    assert sorted(map(tuple, found.select("rule", "file", "line", "occurrences").collect())) == sorted(map(tuple, rules.run_rules(tables).select("rule", "file", "line", "occurrences").collect()))
    assert [(r.rule, r.file, r.line, r.reason) for r in limited.collect()] == [("import.bypass", ".", None, "no-upstream"), ("a11y.focus.suppressed", "a.ts", 1, "unsupported-syntax")]
    # with what they need, rules say nothing; categories choose; scans have no rule
    up = spark.createDataFrame([("p", "w")], "package string, wrapper string")
    scanned = spark.createDataFrame([("b.ts", None, "file-too-large", "9")], schemas.LIMITATIONS)
    tables = rules.Tables(imports=imports, upstream=up)
    found, limited = rules.check(tables, ["api"], scanned)
    assert found.count() == 0 and list(map(tuple, limited.collect())) == [(None, "b.ts", None, "file-too-large", "9")]
    found, limited = rules.check(rules.Tables(imports=imports, upstream=up.limit(0)), ["api"])
    assert [r.reason for r in limited.collect()] == ["no-upstream"]
    found, limited = rules.check(rules.Tables(palette=up), ["font"])
    assert found.count() == 0 and limited.count() == 0
