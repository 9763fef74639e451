"""Exact substring dedup: bytes covered by a 200-byte string that starts anywhere else go.

Prefix doubling ranks every position by its first k bytes and gets the rank by 2k bytes from pairs of ranks; positions
whose rank is unique drop out, and past the threshold those that still share a rank are duplicates. Here the doubling
ends at 100 -> 200 bytes, and ranks are 64-bit hashes that Spark sorts. Ranking every byte from one byte on would write
some twenty times the input in each of eight rounds, so two things are pruned without loss:

* Rank 100 is given to content-chosen positions only. Every 200-byte window holds 101 strings of 100 bytes; the one with
  the least hash is its anchor, so equal windows have equal anchors at equal distances. Windows whose anchor is unique in
  the corpus are unique.
* Neighbouring windows with one anchor form a run, a row of 40 bytes. Runs whose whole context (the bytes that all their
  windows cover) occurs twice are duplicates at once, and need no rank per window; contexts are told by 64-bit hashes, as
  ranks are.

Runs are combined by context in each segment before they are shuffled, as a group-by does map-side, so that copies and
periodic texts do not gather at one anchor. For the runs left, one of each context goes on to rank 200: their windows are hashed with their distance to the anchor
and sorted within the anchor's group. Anchors with more than ``HOT`` contexts are ranked window by window instead, by a
plain group-by of window hashes, counted map-side and joined back, so no group has to fit a task.

Style: Arrow batches for bytes, DataFrames for everything that moves. Texts travel compressed. Defined results: null
texts count as empty; texts under 200 bytes lose nothing; repeated rows are two occurrences of their text, so both lose
every byte they share; null doc_ids are rows like others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table

LENGTH = 200
GRAM = 100
HOT = 4096
#: Rows of one anchor that a task holds at once; more are ranked window by window.
HELD = 262_144
#: Bytes that are hashed in one go; anchors keep their place in this many bits.
SEGMENT, PLACE = 1 << 21, 22

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Hashed:
    """Polynomial hashes of any substrings of a buffer."""

    def __init__(self, buffer: np.ndarray):
        bits = max(PLACE, int(len(buffer) + 1).bit_length())
        self.power, inverse = _powers(bits)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + _U(1)) * inverse[: len(buffer)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.power[start]


def _sliding_argmin(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least gram (leftmost of equals) in each window of ``width`` grams."""
    n = len(grams)
    keys = (grams & ~_U((1 << PLACE) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & _U((1 << PLACE) - 1)).astype(np.int64)


def runs(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, anchor - first window, anchor hash, context hash) of every run of the pieces."""
    lengths = np.array([len(p) for p in pieces])
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths
    if len(buffer) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashed = Hashed(buffer)
    at = np.arange(len(buffer) - GRAM + 1)
    grams = _mix(hashed.of(at, at + GRAM))
    anchors = _sliding_argmin(grams, LENGTH - GRAM + 1)
    marks = np.zeros(len(buffer) + 1, np.int32)
    long = lengths >= LENGTH
    np.add.at(marks, starts[long], 1)
    np.add.at(marks, starts[long] + lengths[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(marks)[: len(anchors)])
    anchors = anchors[windows]
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    n = np.diff(np.concatenate([first, [len(windows)]]))
    lo, anchor = windows[first], anchors[first]
    piece = np.searchsorted(starts, lo, "right") - 1
    context = _mix(hashed.of(lo, lo + n - 1 + LENGTH) + (n * 512 + anchor - lo).astype(np.uint64) * _U(_BASE))
    return piece, lo - starts[piece], n, anchor - lo, grams[anchor], context


#: Marks in ``off`` of what a segment has found by itself: a context it holds twice, and windows that are such.
TWICE, SETTLED = 1 << 10, 1 << 11


def _combine(keys: np.ndarray, p: np.ndarray, n: np.ndarray, off: np.ndarray, gram: np.ndarray, context: np.ndarray) -> list[np.ndarray]:
    """Combines runs of one segment, as a group-by does map-side: of runs with one context the first stands for all.

    The others are settled: neighbours become one row with a key of its own, which any task may get. So an anchor that
    copies or periodic texts repeat without end sends one row a segment and context.
    """
    order = np.lexsort((context, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
    settled = np.zeros(len(p), bool)
    settled[order[1:][same]] = True
    first = np.zeros(len(p), bool)
    first[order[:-1][same]] = True
    off = off + TWICE * (first & ~settled)
    rest = np.flatnonzero(~settled)
    some = np.flatnonzero(settled)
    opens = np.ones(len(some), bool)
    if len(some):
        before, after = some[:-1], some[1:]
        opens[1:] = (after != before + 1) | (keys[after] != keys[before]) | (p[before] + n[before] != p[after])
    head = some[opens]
    total = np.add.reduceat(n[some], np.flatnonzero(opens)) if len(some) else np.zeros(0, np.int64)
    own = _mix(_mix(keys[head].view(np.uint64)) ^ p[head].astype(np.uint64))
    join = lambda a, b: np.concatenate([a, b])
    return [join(gram[rest], own).view(np.int64), join(context[rest].view(np.int64), np.zeros(len(head), np.int64)), join(keys[rest], keys[head]),
            join(p[rest], p[head]), join(n[rest], total).astype(np.int32), join(off[rest], np.full(len(head), SETTLED)).astype(np.int32)]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, row, p, n, off): anchor hash, context hash, text, first window, windows, anchor - first window."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        held: list[bytes] = []
        owner: list[int] = []
        base: list[int] = []
        size = 0

        def flush():
            piece, p, n, off, gram, context = runs(held)
            who, shift = np.array(owner, np.int64), np.array(base, np.int64)
            columns = _combine(keys[who[piece]], p + shift[piece], n, off, gram.view(np.uint64), context.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "row", "p", "n", "off"])

        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            raw = text.as_py() or b""
            for at in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT // 2):
                part = raw[at : at + SEGMENT // 2 + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                if size + len(part) > SEGMENT:
                    yield flush()
                    held, owner, base, size = [], [], [], 0
                held.append(part)
                owner.append(i)
                base.append(at)
                size += len(part)
        if held:
            yield flush()


def _complete(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that rows with one first column stay together (up to ``most`` rows of it)."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        new = np.flatnonzero(key != key[-1])
        at = int(new[-1]) + 1 if len(new) else 0
        same = bool(kept) and kept[-1].column(0)[0].as_py() == key[0] and not len(new)
        if same and (most is None or sum(b.num_rows for b in kept) + batch.num_rows <= most):
            kept.append(batch)
            continue
        if at or not same:
            done = [*kept, batch.slice(0, at)]
            kept = [batch.slice(at)]
        else:
            done, kept = kept, [batch]
        if any(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Each part, whether its first group began in the part before, and whether its last goes on in the next."""
    before, continues = None, False
    for part in parts:
        if before is not None:
            goes_on = before.column(0)[-1].as_py() == part.column(0)[0].as_py()
            yield before, continues, goes_on
            continues = goes_on
        before = part
    if before is not None:
        yield before, continues, False


#: What is known of a run, and what it gives to rank 200.
KNOWN, ASKS, GIVES, HOT_ASKS, HOT_GIVES = 1, 2, 3, 4, 5


def _first_rank(most_contexts: int, held: int):
    """For batches sorted by (h, c): runs with a shared anchor, and their state. Every part of a split group is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, continues, continued in _neighbours(_complete(batches, held)):
            h, c, off = (batch.column(i).to_numpy() for i in (0, 1, 5))
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            group, context = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
            rows = np.bincount(group)[group]
            contexts = np.bincount(group, weights=new_c).astype(np.int64)[group]
            shared = (np.bincount(context) > 1)[context] | (np.bincount(context, weights=off >= TWICE) > 0)[context]
            settled = off >= SETTLED
            split = (continues & (h == h[0])) | (continued & (h == h[-1]))
            hot = (contexts > most_contexts) | (rows >= held // 2) | split
            state = np.where(shared, np.where(new_c & ((contexts > 1) | hot), np.where(hot, HOT_GIVES, GIVES), KNOWN), np.where(hot, HOT_ASKS, ASKS))
            state = np.where(settled, KNOWN, state)
            keep = pa.array(np.flatnonzero((rows > 1) | hot | (off >= TWICE)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:5], pa.array((off % TWICE).astype(np.int32)), pa.array(state.astype(np.int32))], names=["h", "row", "p", "n", "off", "state"]).take(keep)

    return run


def _window_keys(contexts: list[bytes], h: np.ndarray, n: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window in the run, key) of every window: its bytes, its distance to the anchor and the anchor, hashed."""
    lengths = n + LENGTH - 1
    starts = np.cumsum(lengths) - lengths
    hashed = Hashed(np.frombuffer(b"".join(contexts), np.uint8))
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + j
    key = _mix(hashed.of(at, at + LENGTH) + (off[row] - j).astype(np.int64).view(np.uint64) * _U(_BASE))
    return row, j, _mix(key ^ h[row].view(np.uint64))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of asking and giving runs, cut from their texts; windows where the anchor is hot."""
    codec = pa.Codec("zstd")
    names = ["h", "row", "p", "n", "off", "context"]
    for batch in batches:
        for i in range(batch.num_rows):
            raw = codec.decompress(batch.column("z")[i].as_py(), batch.column("bytes")[i].as_py(), asbytes=True)
            row = batch.column("row")[i].as_py()
            asked = batch.column("asked")[i].values
            h, p, n, off, state = (asked.field(c).to_numpy() for c in ("h", "p", "n", "off", "state"))
            for hot in (False, True):
                some = np.flatnonzero((state >= HOT_ASKS) == hot)
                if not len(some):
                    continue
                cuts = [raw[a : a + k + LENGTH - 1] for a, k in zip(p[some].tolist(), n[some].tolist(), strict=True)]
                if not hot:
                    columns = [h[some], np.full(len(some), row), p[some], n[some].astype(np.int32), off[some].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cuts, pa.binary())], names=names)
                else:
                    r, j, key = _window_keys(cuts, h[some], n[some].astype(np.int64), off[some].astype(np.int64))
                    zero = np.zeros(len(r), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(r), row)), pa.array(p[some][r] + j), pa.array(zero), pa.array(zero), pa.nulls(len(r), pa.binary())], names=names)


def _second_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor: ranges (row, p, n) of windows that another context of the anchor has too."""
    for whole in _complete(batches):
        h_all = whole.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], h_all[1:] != h_all[:-1]])).tolist() + [len(h_all)]
        a = 0
        while a < len(edges) - 1:  # some whole groups at a time
            z = a + 1
            while z < len(edges) - 1 and edges[z + 1] - edges[a] <= 8192:
                z += 1
            batch = whole.slice(edges[a], edges[z] - edges[a])
            a = z
            h, row_id, p = (batch.column(c).to_numpy() for c in ("h", "row", "p"))
            n, off = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "off"))
            row, j, key = _window_keys(batch.column("context").to_pylist(), h, n, off)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            double = np.zeros(len(key) + 1, bool)
            double[order[1:][same]] = True
            double[order[:-1][same]] = True
            double = double[:-1]
            opens = double & np.concatenate([[True], ~double[:-1] | (row[1:] != row[:-1])])
            closes = double & np.concatenate([~double[1:] | (row[1:] != row[:-1]), [True]])
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            yield pa.RecordBatch.from_arrays([pa.array(row_id[row[first]]), pa.array(p[row[first]] + j[first]), pa.array((last - first + 1).astype(np.int32))], names=["row", "p", "n"])


def _packed(docs: DataFrame) -> DataFrame:
    """row, bytes, z: the texts, compressed."""
    source = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raws = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in raws], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raws], pa.binary())], names=["row", "doc_id", "bytes", "z"])

    return source.mapInArrow(run, f"row long, doc_id {source.schema['doc_id'].dataType.simpleString()}, bytes long, z binary")


def removed(size: int, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs, from ranges of duplicate windows."""
    if not len(p):
        return p, p
    order = np.argsort(p, kind="stable")
    start, end = p[order], np.maximum.accumulate((p + n - 1 + LENGTH)[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    return start[first], end[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(start) - 1]])]


def _remove(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out = [[], [], [], []]
            for i in range(batch.num_rows):
                size = batch.column("bytes")[i].as_py()
                raw = codec.decompress(batch.column("z")[i].as_py(), size, asbytes=True)
                found = batch.column("ranges")[i].values
                none = np.zeros(0, np.int64)
                p, n = (none, none) if found is None else (found.field(c).to_numpy().astype(np.int64) for c in ("p", "n"))
                start, end = removed(size, p, n)
                left = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), size], strict=True))
                out[0].append(size - len(left))
                out[1].append(len(start))
                out[2].append(hashlib.sha256(left).hexdigest())
                out[3].append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bytes"), *(pa.array(x, pa.int64()) for x in out[:2]), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, keep_text: bool = True, most_contexts: int = HOT, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, null unless asked for)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = keyed.where(F.octet_length("text") >= LENGTH).mapInArrow(_survey, "h long, c long, row long, p long, n int, off int")
    ranked = cut(found.repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(_first_rank(most_contexts, held), "h long, row long, p long, n int, off int, state int"))
    asked = ranked.where(f"state <> {KNOWN}").groupBy("row").agg(F.collect_list(F.struct("h", "p", "n", "off", "state")).alias("asked"))
    packed = _packed(docs)
    fetched = cut(packed.dropDuplicates(["row"]).join(asked, "row").select("row", "bytes", "z", "asked").mapInArrow(_fetch, "h long, row long, p long, n int, off int, context binary"))
    second = fetched.where("context is not null").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_second_rank, "row long, p long, n int")
    hot = fetched.where("context is null").select("h", "row", "p")
    twice = hot.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    ranges = ranked.where(f"state in ({KNOWN}, {GIVES}, {HOT_GIVES})").select("row", "p", "n").unionByName(second).unionByName(
        hot.join(twice, "h").select("row", "p", F.lit(1).alias("n")))
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("p", "n")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return packed.join(by_row, "row", "left").mapInArrow(_remove(keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
