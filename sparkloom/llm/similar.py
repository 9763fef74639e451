"""Near-dedup by Jaccard similarity of word shingles: MinHash bands propose pairs, exact sets decide.

A text is the set of its five-word shingles; texts are linked if the exact Jaccard similarity of their sets is at least
0.8. MinHash values of ``BANDS`` bands of ``ROWS`` lanes give every set as many keys. A pair of similarity s shares none
of them with probability (1 - s^5)^32, which is 3e-6 at 0.8 and less above, whatever the distance of fingerprints.

Pairs inside a key's bucket matter only while they stand in different components, so a bucket of very many near copies
costs a few pairs a member: first every set meets the least of its buckets' leaders (the least set of a bucket), then the
leaders of all buckets in which it is not yet linked. What is still apart then meets in its buckets: there shingles that
two sets share are counted for all of them by products of 0/1 matrices, a block of shingles at a time, and only links that
join components leave a bucket. Buckets of over ``CHUNK`` shingles are cut into chunks, and each chunk meets all that come
before it; none is dropped.

Style: Arrow batches for shingles, DataFrames for everything that moves. Defined results: null, empty and blank texts are
one empty set and alike; a text under five words is one shingle; equal sets are one node with a 64-bit hash for its name;
very long texts are read whole, a section of ``SECTION`` bytes at a time; of a component the smallest doc_id stays, null
last; repeated rows are rows of their own; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, drop_cut, numbered
from sparkloom.llm.components import components

WORDS, SEED = 5, 42
#: Least similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 5
#: Shingles that meet all lanes in one go.
BLOCK = 512
#: Shingles of sets that a task keeps for their next pair; shingles of a chunk of a bucket, and of those at a time.
HELD, CHUNK, COLUMNS = 1 << 22, 1 << 20, 4096
#: Bytes of texts whose words are hashed in one go.
SECTION = 1 << 21

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\f\r")] = True
_FACTOR = 0x9E3779B97F4A7C15

_LANES = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _sections(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Texts end to end, about ``SECTION`` bytes at a time and cut at white space only: (bytes, text of each part, starts)."""
    parts, owner, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + SECTION)
            while end < len(text) and not _WHITE[text[end]]:
                end += 1
            parts.append(text[at:end])
            owner.append(i)
            starts.append(size)
            size += end - at + 1
            at = end
            if size >= SECTION:
                yield b" ".join(parts), owner, starts
                parts, owner, starts, size = [], [], [], 0
    if parts:
        yield b" ".join(parts), owner, starts


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in lower case (A-Z), and the text of each."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for joined, owner, starts in _sections(texts):
        raw = np.frombuffer(joined.lower(), np.uint8)
        inside = ~_WHITE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, end = edges[::2], edges[1::2]
        if not len(first):
            continue
        size = end - first
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        powers = np.full(int(size.max()), _FACTOR, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        total = np.add.reduceat((raw[inside].astype(np.uint64) + _U(1)) * powers[place], np.cumsum(size) - size)
        hashes.append(_mix(total ^ _mix(size.astype(np.uint64))))
        owners.append(np.array(owner)[np.searchsorted(starts, first, "right") - 1])
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of every UTF-8 text."""
    words, owner = _words([t or b"" for t in texts])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    whole = _mix(words + _U(WORDS))
    for k in range(1, min(WORDS, len(words))):
        whole[:-k] = _mix(whole[:-k] * _U(3) + words[k:])
    out = []
    for a, z in zip(bounds, bounds[1:], strict=False):
        if z - a >= WORDS:
            out.append(np.unique(whole[a : z - WORDS + 1]))
        elif z == a:
            out.append(np.zeros(0, np.uint64))
        else:  # the whole sequence, told from shingles by its number of words
            one = _mix(words[a : a + 1] + _U(z - a))
            for k in range(1, z - a):
                one = _mix(one * _U(3) + words[a + k : a + k + 1])
            out.append(one)
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set, one a band."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK] ^ _LANES[0]) * _LANES[1]).min(axis=1), out=least)
    lanes = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(lane.tobytes(), k) for k, lane in enumerate(lanes)], np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        names, sizes, keys = [], [], []
        for found in shingle_sets([t.as_py() for t in batch.column(1).cast(pa.binary())]):
            names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            keys.append(bands(found).view(np.int64))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(keys) + 1, BANDS), pa.int32()), flat)], names=["_row", "name", "size", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: dict[int, np.ndarray] = {}  # sets meet many others
    size = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("u", "v")]
        texts = [batch.column(c).cast(pa.binary()) for c in ("u_text", "v_text")]
        if size > HELD:
            met.clear()
            size = 0
        fresh: dict[int, bytes | None] = {}
        for names, raws in zip(columns, texts, strict=True):
            for i, name in enumerate(names.to_pylist()):
                if name not in met and name not in fresh:
                    fresh[name] = raws[i].as_py()
        met.update(zip(fresh, shingle_sets(list(fresh.values())), strict=True))
        size += sum(len(met[name]) for name in fresh)
        good = [alike(met[u], met[v]) for u, v in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["u", "v"]).filter(pa.array(good, pa.bool_()))


class _Apart:
    """Components that meet in a bucket, and the links found between them."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def of(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            self.root[c] = self.root.get(up, up)
            c = up
        return c

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        for a, b in set(zip(u.tolist(), v.tolist(), strict=True)):
            x, y = self.of(a), self.of(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.found.append((a, b))


def alike_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the sets a[i] and b[j] that reach the similarity, by counting what they share."""
    sizes_a, sizes_b = (np.array([len(x) for x in some], np.int64) for some in (a, b))
    known, column_a = np.unique(np.concatenate(a), return_inverse=True)
    flat_b = np.concatenate(b)
    column_b = np.minimum(np.searchsorted(known, flat_b), max(0, len(known) - 1))
    there = known[column_b] == flat_b if len(known) else np.zeros(len(flat_b), bool)
    row_a, row_b = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
    row_b, column_b = row_b[there], column_b[there]
    # shingles of one side only share nothing
    used, column_b = np.unique(column_b, return_inverse=True)
    place = np.full(len(known), -1)
    place[used] = np.arange(len(used))
    kept = place[column_a] >= 0
    row_a, column_a = row_a[kept], place[column_a[kept]]
    both = np.zeros((len(a), len(b)))
    sides = []
    for row, column, n in ((row_a, column_a, len(a)), (row_b, column_b, len(b))):
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order], n))
    for lo in range(0, len(used), COLUMNS):
        part = []
        for row, column, n in sides:
            some = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
            matrix = np.zeros((n, min(COLUMNS, len(used) - lo)), np.float32)
            matrix[row[some], column[some] - lo] = 1
            part.append(matrix)
        both += part[0] @ part[1].T
    return np.nonzero(DENOMINATOR * both >= NUMERATOR * (sizes_a[:, None] + sizes_b - both))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, text, keys) to a row for each key, with the set."""
    for batch in batches:
        sets = shingle_sets([t.as_py() for t in batch.column(1).cast(pa.binary())])
        keys = batch.column(2)
        times = pc.list_parent_indices(keys)
        rows = pa.array([x.tobytes() for x in sets], pa.large_binary())
        for a in range(0, len(times), 256):
            some = times.slice(a, 256)
            yield pa.RecordBatch.from_arrays([pc.list_flatten(keys).slice(a, 256), batch.column(0).take(some), rows.take(some).cast(pa.binary())], names=["key", "component", "found"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, chunk and role, the chunk's own ones first, to links (u, v) between components."""
    here, own, apart = None, [], _Apart()

    def meet(others: list[tuple[int, np.ndarray]]) -> None:
        for a in range(0, len(own), 1024):
            for b in range(0, len(others), 1024):
                x, y = own[a : a + 1024], others[b : b + 1024]
                i, j = alike_pairs([s for _, s in x], [s for _, s in y])
                u, v = np.array([c for c, _ in x])[i], np.array([c for c, _ in y])[j]
                apart.link(u[u != v], v[u != v])

    def links() -> pa.RecordBatch:
        u, v = zip(*apart.found, strict=True) if apart.found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    complete = True  # whether the chunk's own rows have met each other
    for batch in batches:
        probes: list[tuple[int, np.ndarray]] = []
        for key, chunk, role, component, found in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "role", "component", "found")), strict=True):
            if (key, chunk) != here or (role and not complete):
                meet(probes)
                probes = []
                if not complete:
                    meet(own)
                    complete = True
            if (key, chunk) != here:
                yield links()
                here, own, apart, complete = (key, chunk), [], _Apart(), False
            (probes if role else own).append((component, np.frombuffer(found, np.uint64)))
        meet(probes)
    if not complete:
        meet(own)
    yield links()


def links(distinct: DataFrame, rows: DataFrame, chunk: int = CHUNK, made: list[DataFrame] | None = None) -> DataFrame:
    """Links (u, v) of names, enough for the components, from (name, _row, size, bands) and (_row, text).

    The tables that the links are read from are added to ``made``, to be deleted when the links have been read.
    """
    made = [] if made is None else made

    def kept(df: DataFrame) -> DataFrame:
        made.append(cut(df))
        return made[-1]

    postings = cut(distinct.select("name", "size", F.explode("bands").alias("key")))
    leaders = kept(postings.groupBy("key").agg(F.min("name").alias("leader"), F.max("name").alias("last")).where("leader <> last").select("key", "leader"))
    held = kept(postings.join(leaders, "key"))
    drop_cut(postings)
    # texts that share a key move once by row; later joins meet only these
    texts = kept(rows.join(distinct.select("name", "_row").join(held.select("name").distinct(), "name"), "_row").select("name", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("name").alias(c), F.col("text").alias(f"{c}_text"))
        return kept(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(_verify, "u long, v long"))

    def apart(found: DataFrame) -> DataFrame:
        """Members, with their component, of the buckets that more than one component still shares."""
        joined = components(found, "u", "v")
        named = held.join(joined.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
        named = cut(named)
        split = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("key")
        out = kept(named.join(split, "key"))
        drop_cut(named)
        return out

    tried = kept(held.where("name <> leader").groupBy(F.col("name").alias("v")).agg(F.min("leader").alias("u")).select("u", "v"))
    found = verified(tried)
    left = apart(found)
    heads = left.where("name = leader").select("key", F.col("component").alias("c"))
    second = left.join(heads, "key").where("component <> c").select(F.col("leader").alias("u"), F.col("name").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    found = kept(found.unionByName(verified(second)))
    left = apart(found)

    # what is still apart: every set once with its keys, then by bucket and chunk
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = left.groupBy("name", "component").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    spread = keys.join(texts, "name").select("component", "text", "keys").mapInArrow(_spread, "key long, component long, found binary")
    spread = kept(spread.withColumn("h", F.xxhash64("found")))
    chunks = spread.groupBy("key").agg(F.ceil(F.sum(F.octet_length("found")) / (8 * chunk)).cast("int").alias("chunks"))
    placed = spread.join(chunks, "key").withColumn("own", F.pmod("h", F.greatest("chunks", F.lit(1))).cast("int"))
    dealt = placed.select("key", "component", "found", "own", F.explode(F.sequence("own", F.greatest("chunks", F.lit(1)) - 1)).alias("chunk"))
    dealt = dealt.select("key", "chunk", (F.col("own") != F.col("chunk")).cast("int").alias("role"), "component", "found")
    met = dealt.repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "role").mapInArrow(_meet, "u long, v long")
    return found.unionByName(met)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """_row and root, one for each component, from (_row, text)."""
    marked = cut(rows.select("_row", "text").mapInArrow(_sketches, "_row long, name long, size long, bands array<long>"))
    distinct = cut(marked.join(marked.groupBy("name").agg(F.min("_row").alias("_row")), ["name", "_row"], "left_semi"))
    names = cut(marked.select("_row", "name"))
    drop_cut(marked)
    made: list[DataFrame] = []
    joined = components(links(distinct, rows, made=made), "u", "v")  # read here, so its tables can go
    for table_ in [distinct, *made]:
        drop_cut(table_)
    return names.join(joined, names["name"] == joined["node"], "left").select("_row", F.coalesce("component", "name").alias("root"))


def _united(a: DataFrame, b: DataFrame) -> DataFrame:
    """_row and root of the components that the links of both frames (_row, root) make together."""
    least = lambda x, c: x.join(x.groupBy("root").agg(F.min("_row").alias(c)), "root").select("_row", c)
    both = cut(least(a, "u").join(least(b, "v"), "_row"))
    joined = components(both.where("u <> v").select("u", "v").distinct(), "u", "v")
    return both.join(joined, both["u"] == joined["node"], "left").select("_row", F.coalesce("component", "u").alias("root"))


def drop_near_duplicates(docs: DataFrame, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, null last. ``also`` gives another operator's components,
    (_row, root) from (_row, doc_id, text): the links of both count together, and whole rows are written and moved once."""
    rows = numbered(docs)
    texts = rows.select("_row", "_doc.doc_id", "_doc.text")
    found = near_duplicates(texts) if also is None else _united(also(texts), near_duplicates(texts))
    kept = found.join(texts.drop("text"), "_row").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")
