"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they share
at least five positional bytes. An index of single positional bytes would have 256 lists a position, each a fixed share
of all rows; lists here are keyed by four positional bytes at once. The fourteen blocks of the Steiner system S(3,4,8)
are closed under complement and cover every three positions, so any five shared positions contain a block: no pair of
the wanted kind is missed, and an entry costs fourteen postings however large the corpus. Within a list shared
positional bytes are tallied per pair, pairs with at least five are kept and verified by their differing bits.

Rows are distinct fingerprints: copies are counted into one before indexing. Lists of more than ``HOT`` fingerprints
(bounded by 2^32) are dealt out again: of the four open bytes one must agree as well, and of the other 24 bits one of
four groups of six. The lists that remain have 18 open bits, so they cannot exceed 2^18 fingerprints; neighbours are
looked up there by flipping up to three bits. Lists give links of a spanning forest, never all pairs.

Style: fingerprints and lists run as Arrow batches, everything else as DataFrames. Defined results: null, empty and
blank texts have fingerprint zero and are linked like any other; a null doc_id takes part, but is never a component's
smallest id unless all are null (then the component is null); repeated rows are rows of their own in one component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom.llm.common import cut, numbered, table
from sparkloom.llm.components import components

SEED = 42
BITS = 3
SHARED = 5
HOT = 256
#: Bytes of a text that are read at once, and what ends a section.
SECTION = 1 << 20
INSIDE = re.compile(rb"[^ \t\n\x0b\f\r]*")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes_mask(positions) -> int:
    return sum(0xFF << 8 * p for p in positions)


BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
MASKS = [_bytes_mask(b) for b in BLOCKS]


def _finer(block) -> list[int]:
    masks = []
    for p in range(8):
        if p not in block:
            known = _bytes_mask([*block, p])
            open_bits = [i for i in range(64) if not known >> i & 1]
            masks += [known | sum(1 << i for i in open_bits[k : k + 6]) for k in range(0, 24, 6)]
    return masks


FINER = [_finer(b) for b in BLOCKS]


def _sections(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``SECTION`` bytes of it at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SECTION)
        end += len(INSIDE.match(text, end)[0])
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; of a long one some sections' shingles are held at once."""
    import xxhash

    digest = xxhash.xxh64_digest
    total, ones, last = 0, np.zeros(64, np.int64), []
    for section in _sections((text or b"").lower()):
        found = [*last, *section]
        n = len(found) - words + 1
        if n > 0:
            joined = b" ".join(found)
            ends = list(accumulate(map(len, found), lambda a, x: a + 1 + x))
            starts = [0, *(e + 1 for e in ends[: n - 1])]
            hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)])
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += n
        last = found[max(0, n) :]
    if not total:
        if not last:
            return 0
        ones, total = np.unpackbits(np.frombuffer(digest(b" ".join(last), SEED), np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, a signed long."""
    source = docs.select(*keep, "text")
    schema = StructType([*(source.schema[c] for c in keep), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            fps = [_signed(fingerprint(t.as_py(), words)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the pairs of unsigned fingerprints that are linked: shared positional bytes are tallied for all, and the
    pairs that reach the guaranteed minimum are verified by their bits."""
    tally = np.zeros(len(x), np.int8)
    differ = x ^ y
    for p in range(8):
        tally += differ & np.uint64(0xFF << 8 * p) == 0
    candidates = np.flatnonzero(tally >= SHARED)
    return candidates[np.bitwise_count(differ[candidates]) <= BITS]


def _roots(n: int, pairs) -> np.ndarray:
    """Smallest index reachable, given arrays of linked indices one after another."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root != root[root]).any():
                root = root[root]
    return root


def _list_links(fps: np.ndarray) -> np.ndarray:
    """Index of each fingerprint's representative within one list of distinct fingerprints."""
    m = len(fps)
    if m <= 2048:
        i, j = np.triu_indices(m, 1)
        near = _close(fps[i], fps[j])
        return _roots(m, [(i[near], j[near])])
    order = np.argsort(fps)
    ranked = fps[order]
    varying = int(np.bitwise_or.reduce(ranked ^ ranked[0]))
    bits = [np.uint64(1 << i) for i in range(64) if varying >> i & 1]

    def neighbours():
        for k in range(1, BITS + 1):
            for chosen in combinations(bits, k):
                wanted = ranked ^ np.bitwise_xor.reduce(np.array(chosen))
                at = np.minimum(np.searchsorted(ranked, wanted), m - 1)
                there = np.flatnonzero(ranked[at] == wanted)
                if len(there):
                    yield there, at[there]

    root = _roots(m, neighbours())
    out = np.empty(m, np.int64)
    out[order] = order[root]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (mask, key): fingerprints of one list stand together."""

    def of(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        first = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([first, [len(fp)]]))
        two = first[size == 2]
        near = two[_close(fp[two], fp[two + 1])]
        us, vs = [fp[near]], [fp[near + 1]]
        for a, n in zip(first[size > 2], size[size > 2], strict=True):
            part = fp[a : a + n]
            root = _list_links(part)
            linked = np.flatnonzero(root != np.arange(n))
            us.append(part[linked])
            vs.append(part[root[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        now = [np.concatenate([k, b.to_numpy().view(k.dtype)]) for k, b in zip(kept, batch.columns, strict=True)]
        if not len(now[0]):
            continue
        open_list = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        at = open_list[-1] + 1 if len(open_list) else 0
        kept = [x[at:] for x in now]
        if at:
            yield of(*(x[:at] for x in now))
    if len(kept[0]):
        yield of(*kept)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) of a spanning forest per list, over a frame of distinct fingerprints fp."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posting = lambda i, m: F.struct(F.lit(i).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
    postings = distinct.select("fp", F.explode(F.array(*(posting(i, m) for i, m in enumerate(MASKS)))).alias("p")).select("p.mask", "p.key", "fp")
    hot = cut(postings.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mask", "key"))
    cold = postings.join(hot, ["mask", "key"], "left_anti")
    finer = F.array(*(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)) for masks in FINER))
    dealt = postings.join(hot, ["mask", "key"]).select(
        "fp", F.posexplode(F.get(finer, F.col("mask").cast("int"))).alias("k", "finer"), "mask").select(
        (len(MASKS) + 16 * F.col("mask") + F.col("k")).alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
    lists = cold.select("mask", "key", "fp").unionByName(dealt).repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
    return lists.mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, fp, root (one per component) and component_id (smallest doc_id reachable over links) of every row."""
    rows = cut(fingerprints(docs, words, keep))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select("fp")), "u", "v")
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, null last."""
    rows = numbered(docs)
    found = near_duplicates(rows.select("_doc.doc_id", "_doc.text", "_row"), words, ("doc_id", "_row"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")


def roots(rows: DataFrame, words: int = 5) -> DataFrame:
    """_row and root, one for each component, from (_row, doc_id, text)."""
    return near_duplicates(rows, words, ("doc_id", "_row")).select("_row", "root")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
