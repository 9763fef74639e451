"""Secret scans with corpus-wide ownership frequency.

Three base patterns are found in every whole text. Values they hold, and long tokens of mixed letters and digits that
no base span covers, are candidates. Over the whole corpus the hashes of candidate values are counted by distinct
owners (``source``) and distinct repositories (``doc_id`` here): a value seen by one owner in at most ``REPOS``
repositories looks live, one that several owners or many repositories hold is a widely copied example. The method adds a
span of kind ``owned`` for each live-looking token; base spans always stay.

All of it is DataFrame work. Positions come from splitting a text by the very pattern that was extracted: piece and
match lengths alternate, and their running sums are taken over rows of matches, so that a text with very many matches
costs no more a match than others. Overlaps are told from the latest end before a token and the next start after it.

Offsets are code points, ends exclusive. Defined results: null texts count as empty and have no spans (the digest is that
of the empty string); a null source is one owner of its own; null or repeated doc_ids are rows of their own, and a null
doc_id is one repository of each owner; a value that occurs twice in one place counts there once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, let, table

#: Fixed values of the base rules: kind, pattern, shortest length (of group 2 for assign). For runs of one class the
#: length may stand in the pattern, as a greedy run ends where it ends; assign must be matched first and dropped after.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "owned")
OWNED = 3
#: The method's own candidates: tokens of at least this length with a letter and a digit; most repositories of a live value.
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
REPOS = 3


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0, value_length: int = 0) -> Column:
    """array<struct<kind, gap, len, good, hash>> of the leftmost non-overlapping matches in order, each with the length of
    the piece before it; ``good`` if the value is long enough (and of tokens, if it has a letter and a digit)."""

    def placed(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else m
        zipped = F.arrays_zip(F.slice(pieces, 1, F.size(m)).alias("piece"), m.alias("match"), values.alias("value"))
        good = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") if kind == OWNED else F.length(v) >= value_length
        return F.transform(zipped, lambda x: F.struct(
            F.lit(kind).alias("kind"), F.length(x["piece"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("len"),
            good(x["value"]).alias("good"), F.md5(x["value"]).alias("hash")))

    none = F.array().cast("array<struct<kind:int,gap:long,len:long,good:boolean,hash:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (array of spans), owned (array of added spans), n_live, n_copied."""
    text = F.col("text")
    found = docs.select("doc_id", "source", F.coalesce(text, F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.concat(_matches(text, ASSIGN, 0, 2, ASSIGN_LENGTH), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, TOKEN, OWNED)).alias("m"))
    rows = cut(found)
    matches = rows.where(F.size("m") > 0).select("row", "doc_id", "source", F.posexplode("m").alias("at", "m")).select("row", "doc_id", "source", "at", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by row serves both windows: a group is one document's matches
    spans = matches.repartition(n, "row").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).where("good")
    inside = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < OWNED
    covered = (F.coalesce(F.max(F.when(base, F.col("end"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(inside.rowsBetween(1, Window.unboundedFollowing)), F.col("end")) < F.col("end"))
    candidates = cut(spans.withColumn("covered", covered).where(base | ~F.col("covered")).select("row", "doc_id", "source", "start", "kind", "end", "hash"))
    owners = candidates.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash", "source").agg(F.count("*").alias("repos")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = candidates.select("row", "start", "kind", "end", "hash").join(owners, "hash").withColumn("live", (F.col("owners") == 1) & (F.col("repos") <= REPOS))
    span = F.struct("start", "kind", "end")
    added = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") < OWNED, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("kind") == OWNED), span))).alias("owned"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return rows.select("row", "doc_id").join(added, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("owned", none).alias("owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "owned"))).alias("spans"), "n_live", "n_copied")


def scan_sql(documents: str = "documents") -> str:
    """DuckDB SQL of op5_secrets."""
    kinds = [("assign", ASSIGN.replace("'", "''"), 2, ASSIGN_LENGTH), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0), ("owned", TOKEN, 0, 0)]
    scans = " UNION ALL ".join(f"""
  SELECT row, doc_id, source, {k} AS kind, gaps, matches, vals, {least} AS least, unnest(range(1, len(matches) + 1)) AS i FROM (
    SELECT row, doc_id, source, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS gaps,
           list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS matches, regexp_extract_all(text, '{pattern}', {group}) AS vals
    FROM docs WHERE regexp_matches(text, '{pattern}'))""" for k, (_, pattern, group, least) in enumerate(kinds))
    join = "array_to_string(list({0} ORDER BY s.start, s.kind) {1}, ',')"
    name = "['assign', 'access', 'hex', 'owned'][s.kind + 1] || ':' || s.start || ':' || s.stop"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM {documents}),
scans AS ({scans}),
spans AS (
  SELECT row, doc_id, source, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(matches[1:i - 1]), 0))::BIGINT AS start,
         (list_sum(gaps[1:i]) + list_sum(matches[1:i]))::BIGINT AS stop, vals[i] AS value
  FROM scans WHERE length(vals[i]) >= least),
candidates AS (
  SELECT * FROM spans s WHERE kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.row = s.row AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop))),
owners AS (
  SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (coalesce(source, chr(1)), coalesce(doc_id::VARCHAR, ''))) AS repos
  FROM candidates GROUP BY value),
judged AS (SELECT c.*, owners = 1 AND repos <= {REPOS} AS live FROM candidates c JOIN owners USING (value))
SELECT d.doc_id, count(*) FILTER (WHERE s.kind = 0)::BIGINT AS n_assign, count(*) FILTER (WHERE s.kind = 1)::BIGINT AS n_access, count(*) FILTER (WHERE s.kind = 2)::BIGINT AS n_hex,
       sha256(coalesce({join.format(name, "FILTER (WHERE s.kind < 3)")}, '')) AS base_sha256,
       coalesce({join.format(name, "FILTER (WHERE s.kind < 3 OR s.live)")}, '') AS spans,
       count(*) FILTER (WHERE s.live)::BIGINT AS n_live, count(*) FILTER (WHERE NOT s.live)::BIGINT AS n_copied
FROM docs d LEFT JOIN judged s ON s.row = d.row GROUP BY d.row, d.doc_id"""
