"""Importance resampling towards a target text by hashed word features, counted by an external sort.

Words become unsigned 16-bit buckets. A stream is the buckets of a batch of documents one after another, packed as
little-endian uint16, with the documents' offsets into it; streams are written to the scratch folder once. To count, a
task sorts each stream and run-length encodes it, and Spark adds the runs up by bucket. To score, a task reads the
streams again, gathers every bucket's gain and sums them between the offsets with ``np.add.reduceat``.

Bounded data on the driver: the ``BUCKETS`` counts of either side and their gains. A task holds one Arrow batch and its
stream. Ranks need no global sort in one task: a running sum over the different scores, of which integers between two
logarithms allow a few hundred thousand at most, gives where each score begins, and a window orders the documents of
one score.

Defined results: null and empty texts, and texts without words, have no features, weight 0 and a score like others;
documents with fewer than ``LEAST`` words are scored and never drawn; ties go to the smaller doc_id (null last, hashed as
the empty string), then to the smaller n_features and weight; repeated rows are rows of their own; very long texts are
read whole; an empty table gives an empty result, an empty target counts as nothing in any bucket; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table

BUCKETS = 10_000
#: Fewest words of a document that may be drawn, and percentage of such documents that are.
LEAST, PERCENT = 20, 10
SEED = 2024

#: Bytes of words (digits, letters, anything beyond ASCII), lower-cased; all others are gaps.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
#: Different words whose bucket a worker remembers.
REMEMBERED = 500_000


class _Buckets(dict):
    """Bucket of a word; remembers some, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = zlib.crc32(word) % BUCKETS
        return found


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text) or (text, doc_id) to one row each: doc_ids, offsets of the documents, packed stream."""
    bucket = _Buckets().__getitem__
    for batch in batches:
        parts, offsets = [], np.zeros(batch.num_rows + 1, np.int64)
        for i, text in enumerate(batch.column(0).cast(pa.binary())):
            words = (text.as_py() or b"").translate(_WORDS).split()
            offsets[i + 1] = offsets[i] + len(words)
            parts.append(np.fromiter(map(bucket, words), "<u2", len(words)).tobytes())
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(offsets)], pa.int32()), pa.array(offsets)), pa.array([b"".join(parts)], pa.binary())],
            names=["ids", "offsets", "stream"])


def streams(docs: DataFrame, key: str) -> DataFrame:
    """Written packed streams (ids, offsets, stream) of the texts of a table."""
    kind = docs.schema[key].dataType.simpleString()
    return cut(docs.select("text", key).mapInArrow(_pack, f"ids array<{kind}>, offsets array<bigint>, stream binary"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted and run-length encoded streams."""
    for batch in batches:
        for stream in batch.column(0):
            ordered = np.sort(np.frombuffer(stream.as_py(), "<u2"), kind="stable")
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            lengths = np.diff(np.concatenate([first, [len(ordered)]]))
            yield pa.RecordBatch.from_arrays([pa.array(ordered[first].astype(np.int32)), pa.array(lengths.astype(np.int64))], names=["bucket", "n"])


def bucket_counts(packed: DataFrame) -> np.ndarray:
    """Features of each bucket; ``BUCKETS`` rows at most come to the driver."""
    counts = np.zeros(BUCKETS, np.int64)
    for row in packed.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, a bucket each."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id) -> int:
    """Whole thousandths of a Gumbel variate that the doc_id fixes."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _gather(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy()
                stream = np.frombuffer(batch.column(2)[i].as_py(), "<u2")
                n = np.diff(offsets)
                weight = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)  # reduceat takes no empty ranges
                if len(some):
                    weight[some] = np.add.reduceat(gains[stream], offsets[some]) // n[some]
                score = weight + np.fromiter(map(noise, ids.to_pylist()), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, and rank among the drawn documents (null: not drawn)."""
    packed, kind = streams(docs, "doc_id"), docs.schema["doc_id"].dataType.simpleString()
    gains = gains_of(bucket_counts(packed), bucket_counts(streams(target.withColumn("_", F.lit(0)), "_")))
    scored = cut(packed.mapInArrow(_gather(gains), f"doc_id {kind}, n_features long, weight long, score long"))
    scores = scored.where(F.col("n_features") >= LEAST).groupBy("score").agg(F.count("*").alias("n"))
    starts = scores.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before"),
                           F.expr(f"({PERCENT} * sum(n) over ()) div 100").alias("draw")).where("before < draw")
    able = F.col("n_features") >= LEAST
    place = F.row_number().over(Window.partitionBy("score", able).orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")) + F.col("before")
    return scored.join(starts, "score", "left").select("doc_id", "n_features", "weight", "score", F.when(able & (place <= F.col("draw")), place).cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def resample_sql() -> str:
    """The same in SQL; crc32 by the table that its polynomial gives, byte by byte over the different words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH RECURSIVE bits(i, k, c) AS (
        SELECT i, 0, i FROM range(256) r(i)
        UNION ALL SELECT i, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    d AS (SELECT doc_id, {words} AS ws FROM documents), b AS (SELECT {words} AS ws FROM benchmark),
    vocabulary AS (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM d UNION ALL SELECT unnest(ws) FROM b)),
    folded(w, h, k, c) AS (
        SELECT w, hex(encode(w)), 0, 4294967295::BIGINT FROM vocabulary
        UNION ALL
        SELECT w, h, k + 1, xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255) + 1]) FROM folded, crc WHERE 2 * k < length(h)),
    bucket AS (SELECT w, xor(c, 4294967295) % {BUCKETS} AS bucket FROM folded WHERE 2 * k = length(h)),
    f AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN bucket USING (w)),
    s AS (SELECT bucket, count(*) AS s FROM f GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN bucket USING (w) GROUP BY bucket),
    gains AS (
        SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
        FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weights AS (SELECT doc_id, sum(gain) AS total, count(*) AS n FROM f JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
            floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
        FROM d LEFT JOIN weights USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (n_features >= {LEAST}) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= {LEAST} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM placed"""
