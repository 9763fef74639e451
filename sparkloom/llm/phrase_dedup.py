"""Exact word-level substring dedup with repeated-phrase automata.

A window is 35 consecutive words of a document; every word that a recurring window covers goes. Three steps:

* **Confirm recurring passages.** Each window has an anchor, the ten-word gram of least hash in it; equal windows have
  equal anchors at equal distances. Neighbouring windows with one anchor form a run. Grams are counted over the corpus, and
  runs whose gram is unique are done with. The context of a run is what its windows cover: runs with equal contexts recur
  whole; contexts that share an anchor only are compared window by window. All counts are group-bys, so a passage that a
  third of all rows hold is counted map-side, and joins on anchors are plain equi-joins that adaptive execution splits.
* **Compile.** Recurring windows that follow one another both in a document and in the first occurrence of its passage
  become one phrase, cut from the text of that first occurrence (in blocks of ``BLOCK`` windows, so phrases are bounded).
  Phrases meet the documents that hold them; the phrases of some documents of a batch, of about ``NODES`` words, are one
  shard, compiled into an Aho-Corasick automaton over word numbers (a document with more has several).
* **Stream.** All those documents run through the shard's automaton, which finds every occurrence word for word; the
  words that it covers go. So hashes only say where to look: what is removed was compared with another occurrence's words
  (for the first occurrence itself, its recurrence rests on 64-bit hashes of contexts and windows of one anchor).

Style: words and automata run as Arrow batches, all that moves as DataFrames; texts travel compressed. Defined results:
null texts have no words; texts under 35 words lose nothing; repeated rows are two occurrences, so both lose what they
share; null doc_ids are rows like others; very long texts are worked off in parts of ``PART`` windows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table
from sparkloom.llm.suffix_dedup import Hashed, _mix, _packed, _sliding_argmin

WORDS, GRAM = 35, 10
#: Texts surveyed at once, windows and bytes hashed at once, windows of a block of a passage, words of an automaton.
ROWS, PART, SEGMENT, BLOCK, NODES = 1024, 1 << 18, 1 << 19, 256, 250_000

_FIB = np.uint64(0x9E3779B97F4A7C15)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``SEGMENT`` bytes that end between words."""
    at = 0
    while len(raw) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashes(pieces: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each piece."""
    buffer = np.frombuffer(b" ".join([*pieces, b""]), np.uint8)
    inside = np.concatenate([[False], (buffer != 32) & ((buffer < 9) | (buffer > 13)), [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    found = _mix(Hashed(buffer).of(starts, ends) + (ends - starts).astype(np.uint64) * _FIB)
    return np.split(found, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]))[:-1])


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, owner, size = [], [], 0

    def flush() -> None:
        for who, found in zip(owner, _hashes(held), strict=True):
            out[who].append(found)

    for i, raw in enumerate(texts):
        for piece in _pieces(raw):
            if held and size + len(piece) > SEGMENT:
                flush()
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(i)
            size += len(piece) + 1
    if held:
        flush()
    return [np.concatenate(parts) if len(parts) > 1 else parts[0] for parts in out]


def runs(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(part, first window, windows, anchor - first window, anchor hash, context hash) of every run of parts of word hashes."""
    lengths = np.array([len(p) for p in parts])
    words = np.concatenate([*parts, np.zeros(0, np.uint64)])
    starts = np.cumsum(lengths) - lengths
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(words) < WORDS:
        return none
    hashed, at = Hashed(words), np.arange(len(words) - GRAM + 1)
    grams = _mix(hashed.of(at, at + GRAM))
    anchors = _sliding_argmin(grams, WORDS - GRAM + 1)
    marks, long = np.zeros(len(words) + 1, np.int32), lengths >= WORDS
    np.add.at(marks, starts[long], 1)
    np.add.at(marks, starts[long] + lengths[long] - WORDS + 1, -1)
    windows = np.flatnonzero(np.cumsum(marks)[: len(anchors)])
    if not len(windows):
        return none
    anchors, part = anchors[windows], np.searchsorted(starts, windows, "right") - 1
    while (empty := lengths[part] == 0).any():  # an empty part starts where the next one does
        part = part - empty
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (part[1:] != part[:-1])]))
    n = np.diff(np.concatenate([first, [len(windows)]]))
    lo, anchor, part = windows[first], anchors[first], part[first]
    context = _mix(hashed.of(lo, lo + n - 1 + WORDS) + (n * 64 + anchor - lo).astype(np.uint64) * _FIB)
    return part, lo - starts[part], n, anchor - lo, grams[anchor], context


#: A run's place in 64 bits: first window, windows - 1, anchor - first window.
def _place(p: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return p << 10 | (n - 1) << 5 | off


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (row, text) to runs: anchor hash, context hash, row, place."""
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        keys = batch.column(0).to_numpy()
        found = word_hashes([t.as_py() or b"" for t in batch.column(1).cast(pa.binary())])
        held, owner, base, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            part, p, n, off, gram, context = runs(held)
            columns = [gram.view(np.int64), context.view(np.int64), keys[np.array(owner, np.int64)[part]], _place(p + np.array(base, np.int64)[part], n, off)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "row", "at"])

        for i, words in enumerate(found):
            for at in range(0, len(words) - WORDS + 1, PART):
                part = words[at : at + PART + WORDS - 1]
                if held and size + len(part) > PART:
                    yield flush()
                    held, owner, base, size = [], [], [], 0
                held.append(part)
                owner.append(i)
                base.append(at)
                size += len(part)
        if held:
            yield flush()


FETCHED = "w long, h long, c long, j int, gives boolean, row long, block long, text binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences of contexts, in their texts: window hashes of contexts that share an anchor; texts of their blocks.

    A context is read only where its hash is found again, so two rows that share a key do no harm.
    """
    codec, names = pa.Codec("zstd"), [x.split()[0] for x in FETCHED.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            raw = codec.decompress(batch.column("z")[i].as_py(), batch.column("bytes")[i].as_py(), asbytes=True)
            asked = batch.column("asked")[i].values
            h, c, at = (asked.field(x).to_numpy() for x in ("h", "c", "at"))
            gives, several = (asked.field(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("gives", "several"))
            p, n, off = at >> 10, (at >> 5 & 31) + 1, at & 31
            hashed = Hashed(word_hashes([raw])[0])
            fits = p + n + WORDS - 1 < len(hashed.sums)
            end = np.where(fits, p + n + WORDS - 1, 0)
            fits &= _mix(hashed.of(np.where(fits, p, 0), end) + (n * 64 + off).astype(np.uint64) * _FIB) == c.view(np.uint64)
            some = np.flatnonzero(fits & several)
            run = np.repeat(some, n[some])
            j = np.arange(len(run)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            window = _mix(_mix(hashed.of(p[run] + j, p[run] + j + WORDS) + (off[run] - j).astype(np.int64).view(np.uint64) * _FIB) ^ h[run].view(np.uint64))
            blocks = np.unique(np.concatenate([p[fits] // BLOCK, (p[fits] + n[fits] - 1) // BLOCK]))
            words = raw.split()
            texts = [b" ".join(words[b * BLOCK : (b + 1) * BLOCK + WORDS - 1]) for b in blocks.tolist()]
            r, k = len(run), len(blocks)
            row = batch.column("row")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(window.view(np.int64)), pa.nulls(k, pa.int64())]), *(pa.concat_arrays([pa.array(x[run]), pa.nulls(k, pa.int64())]) for x in (h, c)),
                 pa.concat_arrays([pa.array(j.astype(np.int32)), pa.nulls(k, pa.int32())]), pa.concat_arrays([pa.array(gives[run]), pa.nulls(k, pa.bool_())]),
                 pa.array(np.full(r + k, row)), pa.concat_arrays([pa.nulls(r, pa.int64()), pa.array(blocks)]), pa.concat_arrays([pa.nulls(r, pa.binary()), pa.array(texts, pa.binary())])], names=names)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, block, spans, text) to phrases: stretches of windows of a block that recur and follow one another.

    Rows come sorted by passage, so a text is split once, and documents that hold the same stretches share their phrases.
    """
    text, words, known = None, [], {}
    for batch in batches:
        spans = batch.column(2)
        row_of = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
        flat, base = spans.flatten(), batch.column(1).to_numpy() * BLOCK
        p, mask = flat.field("p").to_numpy() - base[row_of], flat.field("mask").to_numpy()
        recurs = np.zeros((batch.num_rows, BLOCK + 1), bool)
        for j in range(WORDS - GRAM + 1):
            at = p + j
            some = np.flatnonzero((mask >> j & 1 == 1) & (at >= 0) & (at < BLOCK))
            recurs[row_of[some], at[some]] = True
        bits, rows, phrases = np.packbits(recurs, axis=1), [], []
        for i, row in enumerate(batch.column(0).to_pylist()):
            own = batch.column(3)[i].as_py()
            if own != text:
                text, words, known = own, own.split(b" "), {}
            key = bits[i].tobytes()
            if key not in known:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], recurs[i]]).astype(np.int8))).tolist()
                known[key] = [b" ".join(words[a : z + WORDS - 1]) for a, z in zip(edges[::2], edges[1::2], strict=True) if z + WORDS - 1 <= len(words)]
            phrases += known[key]
            rows += [row] * len(known[key])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(phrases, pa.binary())], names=["row", "phrase"])


class Shard:
    """Aho-Corasick automata over the word numbers of a set of phrases."""

    def __init__(self, phrases: Iterable[bytes]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.automata, size = [], NODES
        for phrase in phrases:
            key = tuple([self.number.setdefault(w, len(self.number) + 1) for w in phrase.split(b" ")])
            if size >= NODES:
                self.automata.append(ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE))
                size = 0
            size += len(key)
            self.automata[-1].add_word(key, len(key))
        for automaton in self.automata:
            automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words some occurrence of a phrase covers."""
        number = self.number
        keys = tuple([number.get(w, 0) for w in words])
        ends, lengths = [], []
        for automaton in self.automata:
            for end, length in automaton.iter(keys):
                ends.append(end + 1)
                lengths.append(length)
        marks = np.zeros(len(words) + 1, np.int64)
        stop = np.array(ends, np.int64)
        np.add.at(marks, stop - np.array(lengths, np.int64), 1)
        np.add.at(marks, stop, -1)
        return np.cumsum(marks)[:-1] > 0


def _shards(phrases: pa.ListArray) -> Iterator[tuple[int, int, Shard]]:
    """Documents from, to, and the automata of their phrases: one automaton, or several for a single document."""
    first, size, held = 0, 0, {}
    for i, own in enumerate(phrases):
        new = [x for x in own.as_py() if x not in held]
        more = sum(x.count(b" ") + 1 for x in new)
        if size and size + more > NODES:
            yield first, i, Shard(held)
            first, size, held = i, 0, {}
            new, more = own.as_py(), sum(x.count(b" ") + 1 for x in own.as_py())
        held |= dict.fromkeys(new)
        size += more
    yield first, len(phrases), Shard(held)


def _stream(keep_text: bool):
    """Batches (doc_id, bytes, z, phrases) through the automata of the phrases of some of their documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for first, last, shard in _shards(batch.column("phrases")):
                for i in range(first, last):
                    words = codec.decompress(batch.column("z")[i].as_py(), batch.column("bytes")[i].as_py(), asbytes=True).split()
                    kept = words
                    if shard.automata and len(words) >= WORDS:
                        covered = shard.covered(words)
                        kept = [words[k] for k in np.flatnonzero(~covered).tolist()] if covered.any() else words
                    text = b" ".join(kept)
                    for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:2]), *(pa.array(x, pa.string()) for x in out[2:])], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words, null unless asked for)."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = cut(keyed.where(F.octet_length("text") >= 2 * WORDS - 1).mapInArrow(_survey, "h long, c long, row long, at long"))
    shared = cut(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))  # written, as joins with an aggregate's own output are not split
    held = cut(found.join(shared, "h"))
    contexts = held.groupBy("h", "c").agg((F.count("*") > 1).alias("gives"), F.min(F.struct("row", "at")).alias("first"))
    contexts = cut(contexts)
    several = cut(contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h", F.lit(True).alias("several")))
    contexts = contexts.join(several, "h", "left").select("h", "c", "gives", F.coalesce("several", F.lit(False)).alias("several"), "first.row", "first.at")
    asked = contexts.groupBy("row").agg(F.collect_list(F.struct("h", "c", "at", "gives", "several")).alias("asked"))
    packed = _packed(docs)
    fetched = cut(packed.join(asked, "row").select("row", "bytes", "z", "asked").mapInArrow(_fetch, FETCHED))
    windows = fetched.where("w is not null")
    twice = cut(windows.groupBy("w").agg(F.count("*").alias("k"), F.max("gives").alias("given")).where("k > 1 or given").select("w"))
    masks = windows.where("not gives").join(twice, "w").groupBy("h", "c").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("mask"))
    first = contexts.select("h", "c", F.col("row").alias("from"), F.shiftright("at", 10).alias("p"), F.when(F.col("gives"), F.expr("shiftleft(2, cast(shiftright(at, 5) & 31 as int)) - 1")).alias("all"))
    recurring = cut(first.join(masks, ["h", "c"], "left").select("h", "c", "from", "p", F.coalesce("all", "mask").alias("mask")).where("mask is not null"))
    spans = held.select("h", "c", "row", F.shiftright("at", 10).alias("own")).join(recurring, ["h", "c"]).select(
        "row", "from", (F.col("own") - F.col("p")).alias("shift"), F.struct("p", "mask").alias("span"),
        F.explode(F.expr(f"array_distinct(array(p div {BLOCK}, (p + 25) div {BLOCK}))")).alias("block"))
    spans = spans.groupBy("row", "from", "block", "shift").agg(F.collect_set("span").alias("spans"))
    texts = fetched.where("text is not null").select(F.col("row").alias("from"), "block", "text")
    phrases = spans.join(texts, ["from", "block"]).select("row", "block", "spans", "text").mapInArrow(_phrases, "row long, phrase binary")
    by_row = phrases.groupBy("row").agg(F.collect_set("phrase").alias("phrases"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return packed.join(by_row, "row", "left").select("doc_id", "bytes", "z", F.coalesce("phrases", F.array().cast("array<binary>")).alias("phrases")).mapInArrow(
        _stream(keep_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
