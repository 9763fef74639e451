"""Line dedup by content-defined chunks of lines.

A rolling hash over two line hashes sets a chunk boundary wherever it is least among its neighbours, about every third
line and never on two lines in a row, so boundaries move with the content and not with its place. Chunks of two or more
lines that the corpus holds more than once are removed but for their first occurrence (by doc_id, then place), after a byte
comparison with it. A chunk so removed is an anchor: the lines before and after it go too, as far as they equal the lines
before and after the first occurrence, up to the next boundary there; so the ends of a passage, which share a chunk with
what stands around it, go with it. What is removed always stands earlier in the corpus, in the end at a place that stays.

All of it is DataFrame work. Chunk hashes travel without texts; texts move only to fetch the first occurrences and to
meet them again in the rows that repeat them. A chunk that a third of all rows hold is counted map-side, and the joins
are plain equi-joins that adaptive execution splits. Rows are joined by a hash of (doc_id, text). Within a text every
step is linear in its lines.

Defined results: null texts stay null with no lines; an empty text is one empty line; a document may lose all its
lines and then has an empty text; repeated rows (equal doc_id and text) count as one occurrence and share their fate;
null doc_ids come first in order; very long texts are cut up whole; an empty table gives an empty result; other columns
pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, digits_key, let, table, whole

#: Fixed values of the rolling hash: prime, multiplier, fewest lines of a removable chunk.
PRIME, FACTOR, LEAST = 2147483647, 1000003, 2


def chunks_of(text: Column) -> Column:
    """array<struct<k, lines>>: the chunks of a text in order."""

    def cut_up(lines: Column, rolling: Column) -> Column:
        least = lambda i: (F.get(rolling, i - 1) < F.get(rolling, i - 2)) & (F.get(rolling, i - 1) <= F.coalesce(F.get(rolling, i), F.lit(PRIME)))
        ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | ((i > 1) & least(i)))
        return let(ends, lambda e: F.transform(e, lambda end, k: let(
            F.coalesce(F.get(e, k - 1), F.lit(0)), lambda before: F.struct(k.alias("k"), F.slice(lines, before + 1, end - before).alias("lines")))))

    def roll(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * FACTOR + h) % PRIME)

    return let(F.split(text, "\n", -1), lambda lines: let(let(F.transform(lines, lambda x: digits_key(x) % PRIME), roll), lambda rolling: cut_up(lines, rolling)))


def _dense(gone: Column) -> Column:
    """What is held of the first occurrences, by number of the chunk, from (k, held) sorted by k."""
    none = lambda n: F.array_repeat(F.lit(None).cast(HELD), n)
    return F.flatten(F.transform(gone, lambda g, i: F.concat(none((g["k"] - F.coalesce(F.get(gone, i - 1)["k"], F.lit(-1)) - 1).cast("int")), F.array(g["held"]))))


HELD = "struct<lines:array<string>,before:array<string>,after:array<string>>"


def _common(a: Column, b: Column, back: bool = False) -> Column:
    """How many lines two arrays share from the front (or the back); 0 with null."""
    of = lambda x, i: F.get(x, F.size(x) - i) if back else F.get(x, i - 1)
    both = F.least(F.size(a), F.size(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), both), lambda i: of(a, i) == of(b, i)), F.lit(False)).cast("int")
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.when(first == 0, both).otherwise(first - 1))


def _kept(chunks: Column, held: Column) -> Column:
    """array<array<string>>: the lines of each chunk that stay."""
    anchor = lambda k: F.get(held, k)["lines"] == F.get(chunks, k)["lines"]

    def rest(c: Column) -> Column:
        lines, k = c["lines"], c["k"]
        head = _common(lines, F.when(anchor(k - 1), F.get(held, k - 1)["after"]))
        tail = _common(lines, F.when(anchor(k + 1), F.get(held, k + 1)["before"]), back=True)
        return let(F.struct(head.alias("head"), tail.alias("tail")), lambda x: F.slice(lines, x["head"] + 1, F.greatest(F.size(lines) - x["head"] - x["tail"], F.lit(0))))

    return F.transform(chunks, lambda c: F.when(anchor(c["k"]), F.array().cast("array<string>")).otherwise(rest(c)))


def dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """All columns, text without its repeated chunks, and n_lines, n_removed (lines) if counts are asked for.

    The counts take the place of input columns of their names.
    """
    keyed = docs.select(whole(docs), "doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    chunked = keyed.where("text is not null").select("_row", "doc_id", F.filter(chunks_of(F.col("text")), lambda c: F.size(c["lines"]) >= LEAST).alias("c"))
    chunks = cut(chunked.select("_row", "doc_id", F.explode(F.transform("c", lambda c: F.struct(c["k"].alias("k"), F.xxhash64(c["lines"]).alias("h")))).alias("c")).select("_row", "doc_id", "c.*"))
    first = F.min(F.struct("doc_id", "_row", "k")).alias("first")
    firsts = cut(chunks.groupBy("h").agg(first, F.max(F.struct("doc_id", "_row", "k")).alias("last")).where("first <> last").select(
        "h", F.col("first._row").alias("first_row"), F.col("first.k").alias("first_k")))
    # merged at every size: what is wanted grows with the corpus, so it is not to be broadcast while it happens to be small
    wanted = firsts.groupBy(F.col("first_row").alias("_row")).agg(F.collect_set(F.struct("first_k", "h")).alias("w"))
    fetched = lambda cs, k: F.struct(F.get(cs, k)["lines"].alias("lines"), F.get(cs, k - 1)["lines"].alias("before"), F.get(cs, k + 1)["lines"].alias("after"))
    held = keyed.select("_row", "text").join(wanted.hint("merge"), "_row").select(F.explode(let(
        chunks_of(F.col("text")), lambda cs: F.transform("w", lambda w: F.struct(w["h"].alias("h"), fetched(cs, w["first_k"]).alias("held"))))).alias("x")).select("x.*")
    held = cut(firsts.join(held.groupBy("h").agg(F.min("held").alias("held")), "h"))  # repeated rows give a chunk more than once
    # one plain join over the chunks: nothing above it needs a hash's rows together, so a hash that very many rows hold is split
    later = chunks.join(held, "h").where("_row <> first_row or k <> first_k").select("_row", "k", "held")
    # repeated rows share their chunks: a set holds each once
    gone = later.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("k", "held"))).alias("_gone"))
    joined = keyed.join(gone, "_row", "left")
    held_at = F.when(F.col("_gone").isNotNull(), _dense(F.col("_gone")))
    total = lambda chunks, of: F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + F.size(of(c)))
    kept = let(chunks_of(F.col("text")), lambda cs: let(held_at, lambda h: let(_kept(cs, h), lambda left: F.struct(
        F.array_join(F.flatten(left), "\n").alias("text"), total(cs, lambda c: c["lines"]).alias("n_lines"), total(left, lambda x: x).alias("n_left")))))
    untouched = F.struct(F.col("text").alias("text"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_left"))
    read = joined.withColumn("_kept", F.when(F.col("text").isNull(), None).when(F.col("_gone").isNull(), untouched).otherwise(kept))
    n = [F.coalesce("_kept.n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.col("_kept.n_lines") - F.col("_kept.n_left"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    taken = {"n_lines", "n_removed"} if counts else set()
    return read.select(*(F.col("_kept.text").alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in taken), *n)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def dedup_sql(documents: str = "documents") -> str:
    """DuckDB SQL of op2_lines, for unique doc_ids."""
    common = "CASE WHEN {b} IS NULL THEN 0 ELSE coalesce(list_filter(range(1, least(len(lines), len({b})) + 1), lambda x: {test})[1] - 1, least(len(lines), len({b}))) END"
    head = common.format(b="after", test="lines[x] <> after[x]")
    tail = common.format(b="before", test="lines[len(lines) - x + 1] <> before[len(before) - x + 1]")
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents} WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split),
hashed AS (SELECT doc_id, i, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 15))::BIGINT % {PRIME} AS hash FROM numbered),
rolled AS (SELECT *, (coalesce(lag(hash) OVER (PARTITION BY doc_id ORDER BY i), 0) * {FACTOR} + hash) % {PRIME} AS rolling FROM hashed),
marked AS (
  SELECT *, CASE WHEN rolling < lag(rolling) OVER w AND rolling <= coalesce(lead(rolling) OVER w, {PRIME}) THEN 1 ELSE 0 END AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM marked),
chunks AS (SELECT doc_id, k, list(line ORDER BY i) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k),
ranked AS (
  SELECT *, len(lines) >= {LEAST} AND row_number() OVER w > 1 AS gone, first_value(doc_id) OVER w AS first_id, first_value(k) OVER w AS first_k
  FROM chunks WINDOW w AS (PARTITION BY chunk, len(lines) >= {LEAST} ORDER BY doc_id NULLS FIRST, k)),
anchors AS (
  SELECT r.doc_id, r.k, b.lines AS before, a.lines AS after FROM ranked r
  LEFT JOIN chunks b ON b.doc_id = r.first_id AND b.k = r.first_k - 1 LEFT JOIN chunks a ON a.doc_id = r.first_id AND a.k = r.first_k + 1 WHERE r.gone),
met AS (
  SELECT r.doc_id, r.k, r.lines, r.gone, p.after, n.before FROM ranked r
  LEFT JOIN anchors p ON p.doc_id = r.doc_id AND p.k = r.k - 1 LEFT JOIN anchors n ON n.doc_id = r.doc_id AND n.k = r.k + 1),
kept AS (SELECT doc_id, k, len(lines) AS n, CASE WHEN gone THEN [] ELSE lines[{head} + 1 : len(lines) - {tail}] END AS left_ FROM met)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN array_to_string(flatten(list(r.left_ ORDER BY r.k)), chr(10)) END AS text,
       coalesce(sum(r.n), 0)::BIGINT AS n_lines, coalesce(sum(r.n - len(r.left_)), 0)::BIGINT AS n_removed
FROM {documents} d LEFT JOIN kept r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""
