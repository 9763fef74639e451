"""Packing documents into fixed token windows by minimum bin slack.

A document's ids (byte-level BPE, then one end id) are cut into whole windows and a remainder. Remainders are packed in
blocks of rows that follow one another: the longest remaining length opens a window, a bitset subset-sum dynamic program
over the remaining-length multiset finds the reachable sum closest to the capacity, and backtracking gives the counts of
each length. What a window still lacks is cut from the longest remainder left, at any size alike, so only the last window
of a block can hold padding.

A block is a run of rows of one partition (and of one file, where rows have an order) of at most ``ROWS`` rows and, but for
its last row, ``TOKENS`` tokens, so a task holds a bounded part of its input, no text moves and no corpus-wide histogram is
needed. Blocks keep the order of their rows, and sequence ids follow it: a corpus in training order becomes sequences in
training order, but for the mixing inside a block. The sequences of a block start after those of the blocks before it; the
blocks' sizes are the only rows that meet.

Style: tokenization and packing run as Arrow batches, the numbering as DataFrames. Defined results: null text counts as
empty, which is the end id alone; null and repeated doc_ids are rows of their own; equal rows are interchangeable; very
long texts are cut whole window by whole window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.llm.common import cut, table

WINDOW = 2048
END = 1
#: Fixed value: the vocabulary's added token; its id follows the last piece.
ADDED = "<|endoftext|>"
#: What a block holds.
ROWS, TOKENS = 65_536, 1 << 23


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts as bytes.

    The ids are those of the vocabulary's ``tokenizers`` file (beside the ranks, of the same name) with its default
    settings: the string of an added token in a text is that token. ``tiktoken`` computes them; a text that its pattern
    engine gives up on, such as one with a million spaces in a row, goes to ``tokenizers``.
    """

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: len(ranks)})
        self.path, self.whole = vocabulary.removesuffix(".tiktoken") + ".json", None

    def __call__(self, text: str) -> bytes:
        try:
            ids = self.coding.encode(text, allowed_special="all") if ADDED in text else self.coding.encode_ordinary(text)
        except BaseException as error:
            if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                raise  # the pattern engine's depth limit ends in either, and a panic is no Exception
            ids = self.slow(text)
        return np.array(ids, "<u4").tobytes()

    def slow(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Remainders:
    """The lengths that are left, in order, and the items of each."""

    def __init__(self, items):
        self.items: dict[int, list] = {}
        for item, length in items:
            self.items.setdefault(length, []).append(item)
        self.lengths = sorted(self.items)

    def put(self, item, length: int) -> None:
        if length not in self.items:
            self.items[length] = []
            insort(self.lengths, length)
        self.items[length].append(item)

    def take(self, length: int):
        some = self.items[length]
        item = some.pop()
        if not some:
            del self.items[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return item


def closest(lengths: list[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """length -> count of a multiset whose sum is closest to ``room`` from below; ``lengths`` ascend."""
    full = (1 << (room + 1)) - 1
    reach, trail = 1, []  # bit s: sum s can be reached
    for at in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[at]
        most, part = min(count(length), room // length), 1
        while most > 0 and not reach >> room & 1:  # binary splitting of the count
            part = min(part, most)
            trail.append((length, part, reach))
            reach |= reach << (length * part) & full
            most -= part
            part *= 2
        if reach >> room & 1:
            break
    total, pattern = reach.bit_length() - 1, {}
    for length, part, before in reversed(trail):
        if not before >> total & 1:
            pattern[length] = pattern.get(length, 0) + part
            total -= length * part
    return pattern


def minimum_bin_slack(remainders: list[tuple[int, int]], capacity: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start in the item's remainder, length), from (item, length of its remainder)."""
    left = Remainders(((item, 0), length) for item, length in remainders)
    while left.lengths:
        seed = left.lengths[-1]
        window, room = [(*left.take(seed), seed)], capacity - seed
        pattern = closest(left.lengths, lambda x: len(left.items[x]), room) if room else {}
        for length, n in pattern.items():
            room -= length * n
            window += [(*left.take(length), length) for _ in range(n)]
        if room and left.lengths:  # what is left is longer than the room, or it would have been taken
            length = left.lengths[-1]
            item, start = left.take(length)
            window.append((item, start, room))
            left.put((item, start + room), length - room)
        yield window


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "file", "block", "sequence", "offset"]


class _Block:
    """Rows that are packed together: their pieces so far and the remainders still to be placed."""

    def __init__(self, file: str, number: int):
        self.file, self.number = file, number
        self.rows = self.tokens = self.sequences = 0
        self.doc_ids: list[pa.Array] = []
        self.held: list[tuple[int, int, bytes, int]] = []  # row, start, ids, tokens of the document
        self.out: list[list[int]] = [[] for _ in range(7)]  # row, start, length, crc, tokens, sequence, offset

    def add(self, ids: bytes) -> None:
        n, here, view = len(ids) // 4, 0, memoryview(ids)
        while n - here >= WINDOW:
            self.piece(self.rows, here, view[4 * here : 4 * (here + WINDOW)], n, 0)
            self.sequences += 1
            here += WINDOW
        if here < n:
            self.held.append((self.rows, here, ids[4 * here :], n))
        self.rows += 1
        self.tokens += n

    def piece(self, row: int, start: int, ids, tokens: int, offset: int) -> None:
        for column, value in zip(self.out, (row, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequences, offset), strict=True):
            column.append(value)

    def packed(self) -> pa.RecordBatch:
        for window in minimum_bin_slack([(i, len(ids) // 4) for i, (_, _, ids, _) in enumerate(self.held)]):
            offset = 0
            for i, start, length in window:
                row, base, ids, tokens = self.held[i]
                self.piece(row, base + start, ids[4 * start : 4 * (start + length)], tokens, offset)
                offset += length
            self.sequences += 1
        columns = [pa.array(x, pa.int64()) for x in self.out]
        doc_ids = pa.concat_arrays(self.doc_ids).take(columns[0])
        n = len(doc_ids)
        return pa.RecordBatch.from_arrays([doc_ids, *columns[1:5], pa.repeat(pa.scalar(self.file, pa.string()), n), pa.repeat(pa.scalar(self.number, pa.int64()), n), *columns[5:]], names=NAMES)


def _pack_blocks(vocabulary: str, most_rows: int, most_tokens: int):
    """Batches (doc_id, text, file, row) to pieces, with their block and the sequence and offset in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        end = np.array([END], "<u4").tobytes()
        block = None
        for batch in batches:
            first = 0  # row of the batch with which the block goes on
            for i, text in enumerate(batch.column(1)):
                file = batch.column(2)[i].as_py()
                if block is None or file != block.file or block.rows >= most_rows or block.tokens >= most_tokens:
                    if block is not None:
                        block.doc_ids.append(batch.column(0).slice(first, i - first))
                        yield block.packed()
                    first, block = i, _Block(file, batch.column(3)[i].as_py())
                block.add(encode(text.as_py() or "") + end)
            if block is not None:
                block.doc_ids.append(batch.column(0).slice(first))
        if block is not None:
            yield block.packed()

    return run


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of every row of a table, which order its rows; of a frame that is no file, a number in its order."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_row")
    return F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")


def pack(docs: DataFrame, vocabulary: str | None = None, rows: int = ROWS, tokens: int = TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    source = docs.select("doc_id", "text", *place(docs))
    schema = StructType([source.schema["doc_id"], *(StructField(c, StringType() if c == "file" else LongType()) for c in NAMES[1:])])
    pieces = cut(source.mapInArrow(_pack_blocks(vocabulary or default_vocabulary(), rows, tokens), schema))
    sizes = pieces.groupBy("file", "block").agg((F.max("sequence") + 1).alias("n"))
    before = lambda n, w: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    # by file, then by block in the file: a row of either is a whole block of documents
    files = sizes.groupBy("file").agg(F.sum("n").alias("in_file"))
    starts = files.select("file", before("in_file", Window.orderBy("file")).alias("file_start"))
    blocks = sizes.select("file", "block", before("n", Window.partitionBy("file").orderBy("block")).alias("block_start"))
    first = blocks.join(starts, "file").select("file", "block", (F.col("file_start") + F.col("block_start")).alias("first"))
    return pieces.join(first, ["file", "block"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
