"""Alignment of two tokenizations of the same text by a dangling-suffix transducer.

The transducer reads the tokens of both sides in turn. Its state is the side that leads, that side's last token and the
bytes of it which the other side has not matched yet (the dangling suffix); the next token always comes from the side
behind. A transition depends on the state and that token alone and is memoised; each transition from a dangling suffix is
one link (the two tokens overlap), and an empty suffix closes a group. Both tokenizers never join a character that is not
white space with a space or line feed after it, so the suffix is empty there too: texts are cut into such chunks, and the
transducer's whole way through a chunk is memoised by the chunk. A text with a chunk whose bytes do not come back is run
through in one piece.

Counting id pairs over the corpus without moving links: documents are taken in blocks of one partition (at most ``ROWS``
documents and, but for the last one, ``CHUNKS`` chunks). A block writes one row for each document (its chunks by number)
and one dictionary: its chunks' pairs, and how often the block holds each pair. Only the dictionaries' different pairs are
shuffled, added up by pair and given back to their blocks, where documents and counts meet as co-groups. A pair that all
blocks hold is one row a block; highest counts by B id are as many rows as the vocabulary has ids.

Style: tokenizers and transducer run as Arrow batches, counts as DataFrames. Defined results: null and empty texts, and
texts whose bytes do not come back from both sides, have no tokens: zeros and an empty groups_sha256; null and repeated
doc_ids are rows of their own; very long texts are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table

#: What a block holds.
ROWS, CHUNKS = 65_536, 2_000_000
#: Characters of a chunk up to which tiktoken computes the ids; longer ones go to tokenizers, which knows no depth limit.
SHORT = 5_000
#: Transitions that a worker remembers.
REMEMBERED = 2_000_000
#: Chunks that a worker remembers besides those of its block (twice as many at most), and the characters of the longest.
RECENT, LONGEST = 350_000, 64

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_PLAIN = re.compile(r"[ \n]+[^ \n]*")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def _byte_of() -> dict[str, int]:
    """Byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: ids and bytes of a byte-level BPE vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte_of, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
        self.bytes = {i: t.encode() if t in special else bytes(map(byte_of.__getitem__, t)) for t, i in model["model"]["vocab"].items()}
        ranks = {raw: i for i, raw in self.bytes.items() if raw.decode("utf-8", "replace") not in special}
        self.short = tiktoken.Encoding("side_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.short.encode_ordinary(text) if len(text) <= SHORT else self.whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """Side B: ids and bytes of a piece vocabulary with byte fallback, which puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.space = self.model.piece_to_id("▁")
        #: whether no piece reaches over a cut between chunks
        self.cuts = not any(re.search("[^\\s▁][▁ \n]", p) for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of chunks, each of which begins with a space or line feed."""
        found = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [(ids if len(t) > 1 else [self.space]) if t[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for t, ids in zip(texts, found, strict=True)]


class Transducer:
    """Aligns two token sequences over the same bytes."""

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[int, int, bytes], int] = {}
        #: side, leader, residual and next states by token of each state
        self.known: list[tuple[int, int, bytes, dict[int, int]]] = []
        #: states after a first token of side A
        self.first: dict[int, int] = {}
        self.steps = 0

    def state(self, side: int, token: int, residual: bytes) -> int:
        found = self.states.setdefault((side, token, residual), len(self.known))
        if found == len(self.known):
            self.known.append((side, token, residual, {}))
        return found

    def step(self, state: int, token: int) -> int:
        """State after the side behind adds ``token``: -1 the suffix is empty, -2 the bytes differ."""
        side, leader, residual, _ = self.known[state]
        added = self.bytes[1 - side][token]
        if added == residual:
            return -1
        if residual.startswith(added):
            return self.state(side, leader, residual[len(added):])
        return self.state(1 - side, token, added[len(residual):]) if added.startswith(residual) else -2

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]] | None:
        """Groups (a from, a to, b from, b to) and links (a id, b id); None if the bytes differ."""
        found = self.run(a, b)
        if found is None:
            return None
        ends_a, ends_b, _, links_a, links_b = found
        return list(zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)), list(zip(links_a, links_b, strict=True))

    def run(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]] | None:
        """Where each group ends in A, in B and in the links; the ids of A and of B that are linked. None if the bytes differ."""
        if self.steps > REMEMBERED:
            self.forget()
        known, first = self.known, self.first
        ends_a, ends_b, ends, links_a, links_b = [], [], [], [], []
        i = j = 0
        n_a, n_b = len(a), len(b)
        while i < n_a:
            token = a[i]
            i += 1
            state = first.get(token, -3)
            if state == -3:
                state = first[token] = self.state(0, token, self.bytes[0][token])
            while state >= 0:
                side, leader, _, after = known[state]
                if side:
                    if i == n_a:
                        return None
                    token = a[i]
                    i += 1
                    links_a.append(token)
                    links_b.append(leader)
                else:
                    if j == n_b:
                        return None
                    token = b[j]
                    j += 1
                    links_a.append(leader)
                    links_b.append(token)
                before, state = state, after.get(token, -3)
                if state == -3:
                    state = after[token] = self.step(before, token)
                    self.steps += 1
            if state == -2:
                return None
            ends_a.append(i)
            ends_b.append(j)
            ends.append(len(links_a))
        return (ends_a, ends_b, ends, links_a, links_b) if j == n_b else None


def _written(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[str]:
    """Each group as a string."""
    return [f"{a[p]}|{b[r]}" if q - p == 1 == s - r else f"{','.join(map(str, a[p:q]))}|{','.join(map(str, b[r:s]))}"
            for p, q, r, s in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)]


def _codes(links_a: list[int], links_b: list[int], size: int) -> np.ndarray:
    return np.array(links_a, np.int64) * size + np.array(links_b, np.int64)


class Aligner:
    """Both vocabularies, the transducer between them, and the chunks it went through lately, whatever block they were in."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.a_sizes = np.zeros(max(self.a.bytes) + 1, np.int64)
        for i, raw in self.a.bytes.items():
            self.a_sizes[i] = len(raw)
        self.lately: dict[str, tuple[int, int, int, str, bytes]] = {}
        self.before: dict[str, tuple[int, int, int, str, bytes]] = {}

    def aligned(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """n_a, n_b, n_groups, groups as a string, pair codes of texts that begin with a space or line feed; n_a is -1 if bytes differ."""
        lately, before = self.lately, self.before
        new = [t for t in texts if t not in lately and t not in before]
        found = dict(zip(new, self._run(new), strict=True)) if new else {}
        out = [lately.get(t) or before.get(t) or found[t] for t in texts]
        lately.update((t, x) for t, x in zip(texts, out, strict=True) if len(t) <= LONGEST)
        if len(lately) > RECENT:
            self.lately, self.before = {}, lately
        return out

    def _run(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        # a chunk that ends in white space is cut otherwise when another follows
        plain = [t for t in texts if len(t) <= LONGEST and not t[-1].isspace()] if self.b.cuts and len(texts) > 1 else []
        joined = self._run_joined(plain) if plain else None
        if joined is None:
            return [self._run_one(t, b) for t, b in zip(texts, self.b.ids(texts), strict=True)]
        if len(plain) == len(texts):
            return joined
        done = dict(zip(plain, joined, strict=True))
        rest = [t for t in texts if t not in done]
        done.update((t, self._run_one(t, b)) for t, b in zip(rest, self.b.ids(rest), strict=True))
        return [done[t] for t in texts]

    def _run_one(self, text: str, b: list[int]) -> tuple[int, int, int, str, bytes]:
        a = self.a.ids(text)
        # the transducer holds the bytes of B against those of A
        found = self.transducer.run(a, b) if b"".join(map(self.a.bytes.__getitem__, a)) == text.encode() else None
        if found is None:
            return -1, 0, 0, "", b""
        ends_a, ends_b, _, links_a, links_b = found
        return len(a), len(b), len(ends_a), ";".join(_written(a, b, ends_a, ends_b)), _codes(links_a, links_b, self.b.size).tobytes()

    def _run_joined(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]] | None:
        """The same for chunks that both sides cut alike, end to end in one go; None if a chunk's bytes do not come back."""
        text = "".join(texts)
        raw = text.encode()
        a = self.a.short.encode_ordinary(text)
        b = self.b.model.encode(text[1:]) if text[0] == " " else self.b.ids([text])[0]
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        found = self.transducer.run(a, b)
        if found is None:
            return None
        ends_a, ends_b, ends, links_a, links_b = found
        bytes_to = np.cumsum(self.a_sizes[a])[np.array(ends_a) - 1]
        chunk_to = np.cumsum([len(t.encode()) for t in texts] if len(raw) > len(text) else [len(t) for t in texts])
        last = np.searchsorted(bytes_to, chunk_to)
        if not np.array_equal(bytes_to[last], chunk_to):
            return None
        groups = [0, *(last + 1).tolist()]
        to_a, to_b, to_link = ([0, *np.array(x)[last].tolist()] for x in (ends_a, ends_b, ends))
        written, codes = _written(a, b, ends_a, ends_b), _codes(links_a, links_b, self.b.size).tobytes()
        return [(to_a[k + 1] - to_a[k], to_b[k + 1] - to_b[k], g - f, written[f] if g - f == 1 else ";".join(written[f:g]), codes[8 * to_link[k] : 8 * to_link[k + 1]])
                for k, (f, g) in enumerate(zip(groups, groups[1:], strict=False))]

    def chunks(self, text: str) -> list[str]:
        """Where both sides cut alike, the pieces of a text that begins with a space."""
        if not self.b.cuts:
            return [text]
        return _CUT.split(text) if _OTHER_SPACE.search(text) else _PLAIN.findall(text)


class _Block:
    """Documents that share a dictionary of chunks."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.number: dict[str, int] = {}
        self.sizes = [array("q"), array("q"), array("q")]  # n_a, n_b, n_groups of each chunk; -1: bytes differ
        self.odd: set[int] = set()
        self.written: list[str] = []
        self.codes, self.ends = bytearray(), array("q", [0])
        self.docs: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.total = 0

    def read(self, texts: list[str]) -> list[int]:
        """Numbers of chunks; those the block has not met are aligned together."""
        number = self.number
        own = list(map(number.get, texts))
        if None in own:
            new = list(dict.fromkeys([t for t, k in zip(texts, own, strict=True) if k is None]))
            for text, (n_a, n_b, n_groups, written, codes) in zip(new, self.aligner.aligned(new), strict=True):
                if n_a < 0:
                    self.odd.add(len(self.written))
                number[text] = len(self.written)
                for column, value in zip(self.sizes, (n_a, n_b, n_groups), strict=True):
                    column.append(value)
                self.written.append(written)
                self.codes += codes
                self.ends.append(len(self.codes) // 8)
            own = list(map(number.__getitem__, texts))
        return own

    def add(self, text: str | None) -> None:
        own = []
        if text:
            own = self.read(self.aligner.chunks(" " + text))
            if not self.odd.isdisjoint(own):
                whole = self.read([" " + text])
                own = [] if whole[0] in self.odd else whole
        self.hashes.append(hashlib.sha256(";".join(map(self.written.__getitem__, own)).encode()).hexdigest() if own else "")
        self.docs.append(np.array(own, np.uint32))
        self.total += len(own)

    def rows(self, block: int, doc_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """The dictionary's row, then the documents' rows."""
        codec = pa.Codec("zstd")
        chunks = np.concatenate([*self.docs, np.zeros(0, np.uint32)])
        times = np.bincount(chunks, minlength=len(self.written))
        links = np.diff(np.frombuffer(self.ends, np.int64))
        pairs, at = np.unique(np.frombuffer(self.codes, np.int64), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.repeat(times, links))
        packed = at.astype("<u4").tobytes()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.nulls(1, doc_ids.type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.array([len(packed)]), pa.array([codec.compress(packed, asbytes=True)], pa.binary()),
             pa.array([codec.compress(links.astype("<u4").tobytes(), asbytes=True)], pa.binary()), pa.array([len(links)]), one(pairs), one(counts)], names=NAMES)
        sizes = [np.frombuffer(column, np.int64) if len(column) else np.zeros(0, np.int64) for column in self.sizes]
        ends = np.cumsum([len(d) for d in self.docs])
        sums = [np.concatenate([[0], np.cumsum(x[chunks])]) for x in (*sizes, links)]
        sums = [x[ends] - np.concatenate([[0], x[ends[:-1]]]) for x in sums]
        n = len(self.docs)
        kept = [codec.compress(np.sort(d).astype("<u4").tobytes(), asbytes=True) for d in self.docs]
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block, pa.int64()), n), doc_ids, *map(pa.array, sums), pa.array(self.hashes, pa.string()), pa.array([4 * len(d) for d in self.docs], pa.int64()), pa.array(kept, pa.binary()),
             pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)


#: ``z``, ``bytes``: a document's chunk numbers, or the pair numbers of all chunks of a dictionary; ``links``: pairs a chunk.
NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bytes", "z", "links", "chunks", "pairs", "counts"]


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(path_a, path_b)


def _blocks(path_a: str, path_b: str, most_rows: int, most_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, ids, number = _aligner(path_a, path_b), None, [], TaskContext.get().partitionId() << 33
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1)):
                if block is not None and (len(block.docs) >= most_rows or block.total >= most_chunks):
                    yield from block.rows(number, pa.concat_arrays([*ids, batch.column(0).slice(first, i - first)]))
                    block, ids, first, number = None, [], i, number + 1
                block = block or _Block(aligner)
                block.add(text.as_py())
            ids.append(batch.column(0).slice(first))
        if block is not None:
            yield from block.rows(number, pa.concat_arrays(ids))

    return run


def _settle(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of each document of a block: counts of its links, and links whose count is the highest of their B id."""
    codec = pa.Codec("zstd")
    at = counts.column("at").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
    unpack = lambda z, size: np.frombuffer(codec.decompress(z, size, asbytes=True), "<u4") if size else np.zeros(0, "<u4")
    columns = {c: docs.column(c) for c in ("bytes", "z", "links", "chunks")}
    per_chunk = [np.zeros(0, np.int64)] * 2
    dictionary = [i for i, x in enumerate(columns["chunks"].to_pylist()) if x is not None]
    for i in dictionary:
        pairs = unpack(columns["z"][i].as_py(), columns["bytes"][i].as_py())
        links = unpack(columns["links"][i].as_py(), 4 * columns["chunks"][i].as_py())
        ends = np.cumsum(links, dtype=np.int64)
        for k, value in enumerate((best, total)):
            sums = np.concatenate([[0], np.cumsum(value[pairs])])
            per_chunk[k] = sums[ends] - sums[ends - links]
    own = np.setdiff1d(np.arange(docs.num_rows), dictionary)
    found = [[], []]
    for i in own.tolist():
        chunks = unpack(columns["z"][i].as_py(), columns["bytes"][i].as_py())
        for k in range(2):
            found[k].append(int(per_chunk[k][chunks].sum()))
    kept = docs.take(pa.array(own, pa.int64()))
    return pa.table([*(kept.column(c) for c in NAMES[1:6]), *(pa.array(x, pa.int64()) for x in found), kept.column("groups_sha256")],
                    names=[*NAMES[1:6], "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, rows: int = ROWS, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    return _measured(docs, path_a, path_b, rows, chunks)[0]


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, rows: int = ROWS, chunks: int = CHUNKS) -> DataFrame:
    """a_id, b_id, n (links that hold the pair, corpus-wide) and best (n is the highest of the b_id)."""
    return _measured(docs, path_a, path_b, rows, chunks)[1]


def _measured(docs: DataFrame, path_a: str | None, path_b: str | None, rows: int, chunks: int) -> tuple[DataFrame, DataFrame]:
    paths = default_paths()
    path_a, path_b = path_a or paths[0], path_b or paths[1]
    kind, size = docs.schema["doc_id"].dataType.simpleString(), Pieces(path_b).size
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bytes long, z binary, links binary, chunks long, pairs array<bigint>, counts array<bigint>"
    made = cut(docs.select("doc_id", "text").mapInArrow(_blocks(path_a, path_b, rows, chunks), schema))
    asked = made.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair") % size)
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))  # a row for each id of the vocabulary at most
    totals = cut(totals.join(F.broadcast(highest), "b_id").select("pair", "b_id", "total", (F.col("total") == F.col("highest")).cast("int").alias("best")))
    counts = asked.drop("n").join(totals, "pair").select(F.col("block").alias("to"), "at", "total", "best")
    settled = made.drop("pairs", "counts").groupBy("block").cogroup(counts.groupBy("to")).applyInArrow(
        _settle, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return settled, totals.select(F.floor(F.col("pair") / size).alias("a_id"), "b_id", F.col("total").alias("n"), (F.col("best") == 1).alias("best"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
