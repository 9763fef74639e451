"""Language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public byte-level vocabulary, of whatever length. Each language has a probability per piece,
fitted by expectation maximisation over all segmentations of the words of its sample. A text's likelihood under a language
is the product over its words (lower case, with a space before) of the word's probability, which a forward algorithm sums
over all segmentations into pieces; a word of any length is summed whole, with scaled probabilities. Words are the runs
between white space, in lower case, what is not a letter in them being one space. With the languages'
shares as priors, that gives a posterior: its largest value is the score.

The pieces that lie anywhere in a batch of words are found for all places at once by a table of trie states, one byte a
step; the forward sums then go by place in the word, for all words of the batch at once.

Learning uses text and lang only, of rows that are not held out: a bounded sample of at most ``SAMPLE`` different texts a
language, chosen by a hash of the text, of each a passage of at most ``PASSAGE`` characters. Prediction reads every whole
text, and nothing else; each different word of some ``SLICE`` bytes of texts is summed once.

Style: the model (vocabulary x languages) is fitted on the driver from word counts of the sample; scoring runs as Arrow
batches without any shuffle. Defined results: null texts, empty ones and those without a letter give ``und`` and score
0, and so does every text where no language can be learned; null langs teach nothing; null doc_ids are not held out;
repeated rows are predicted alike and count once in the sample; an empty table gives an empty result; other columns are
ignored. The languages of a table are taken to be few: one row each comes to the driver.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkloom.llm.common import table

SAMPLE = 300
PASSAGE = 4_000
ROUNDS = 3
SMOOTHING = 0.05
#: Bytes of words that are summed at once, of texts that are read at once, and places of one scale.
GRID, SLICE, SCALED = 1 << 16, 1 << 23, 32
#: Pieces with a capital, a digit, a mark of ASCII or an inner space cannot lie in a word.
CAN_MATCH = re.compile(rb" ?[a-z\x80-\xff]+| ")
NOT_LETTERS = r"[^\p{L}\p{M}]+"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Pieces:
    """The vocabulary as a table of trie states: ``step[state, byte]`` is the next state, 0 where no piece goes on."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            found = {base64.b64decode(x.split()[0]) for x in lines}
        found = sorted(x for x in found if CAN_MATCH.fullmatch(x))
        self.size = len(found)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, piece in enumerate(found):
            at = 0
            for byte in piece:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][byte]
            ends[at] = number
        # states with a next state come first, so the others need no row
        order = sorted(range(len(children)), key=lambda s: not children[s])
        name = np.empty(len(order), np.int32)
        name[order] = np.arange(len(order))
        self.inner = sum(map(bool, children))
        self.step = np.zeros((self.inner, 256), np.int32)
        for state, below in enumerate(children):
            for byte, to in below.items():
                self.step[name[state], byte] = name[to]
        self.piece = np.array(ends, np.int32)[order]

    def arcs(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, piece) of every piece that lies anywhere in a word; ``text`` holds the words end to end."""
        base = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        last = np.repeat(base + lengths, lengths)
        flat = self.step.ravel()
        at = np.arange(len(text))
        state = self.step[0].take(text)
        found, depth = [], 1
        while len(at):
            piece = self.piece.take(state)
            hit = np.flatnonzero(piece >= 0)
            found.append((at.take(hit), np.full(len(hit), depth), piece.take(hit)))
            on = np.flatnonzero((state > 0) & (state < self.inner) & (last.take(at) > at + depth))
            at = at.take(on)
            state = flat.take(state.take(on) * 256 + text.take(at + depth))
            depth += 1
        at, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        row = row.take(at)
        start = at - base.take(row)
        return row, start, start + size, piece


def forward(n: int, m: int, row: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled probability of the first k bytes of each word by language, [language, m + 1, n], and the logarithm of the
    scale that ``SCALED`` places share, [language, m // SCALED + 1, n]."""
    order = np.argsort((end * n + row).astype(np.int32 if (m + 1) * n < 1 << 31 else np.int64))
    row, start, end, piece = row.take(order), start.take(order), end.take(order), piece.take(order)
    edges = np.searchsorted(end, np.arange(m + 2))
    source, target = start * n + row, end * n + row
    opens = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    firsts = np.searchsorted(opens, edges)
    alpha = np.zeros((len(table_), (m + 1) * n))
    alpha[:, :n] = 1
    scale = np.zeros((len(table_), m // SCALED + 1, n))
    for one, probability, mine in zip(alpha, table_, scale, strict=True):
        p = probability.take(piece)
        for k in range(1, m + 1):
            a, z = edges[k], edges[k + 1]
            if a == z:
                continue
            share = one.take(source[a:z]) * p[a:z]
            block = k // SCALED
            if k % SCALED == 0:
                mine[block] = mine[block - 1]
            if block:
                share *= np.exp(mine[start[a:z] // SCALED, row[a:z]] - mine[block].take(row[a:z]))
            heads = opens[firsts[k] : firsts[k + 1]]
            one[target.take(heads)] = np.add.reduceat(share, heads - a)
            if k % SCALED == 0:
                now = one[k * n : (k + 1) * n]
                known = np.where(now > 0, now, 1)
                mine[block] += np.log(known)
                now /= known
    return alpha.reshape(len(table_), m + 1, n), scale


def grids(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, bytes end to end, lengths) of the words, shortest first, as many at once as make ``GRID`` bytes padded."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        z = min(len(order), a + max(1, GRID // (int(lengths[order[a]]) + 1)))
        while z > a + 1 and (z - a) * (int(lengths[order[z - 1]]) + 1) > 2 * GRID:
            z = a + (z - a) // 2
        some = order[a:z]
        part = words.take(pa.array(some))
        yield some, np.frombuffer(part.buffers()[2] or b"", np.uint8)[: int(lengths[some].sum())], lengths[some]
        a = z


def _totals(alpha: np.ndarray, scale: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    which = np.arange(len(lengths))
    return np.log(np.maximum(alpha[:, lengths, which], 1e-300)) + scale[:, lengths // SCALED, which]


def log_likelihoods(words: pa.Array, pieces: Pieces, table_: np.ndarray) -> np.ndarray:
    """[language, word]."""
    out = np.zeros((len(table_), len(words)))
    for some, text, lengths in grids(words):
        out[:, some] = _totals(*forward(len(some), int(lengths.max()), *pieces.arcs(text, lengths), table_), lengths)
    return out


def fit(words: pa.Array, counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece probabilities [language, piece] from word counts [language, word] by expectation maximisation."""
    table_ = np.full((len(counts), pieces.size), 1 / max(1, pieces.size))
    batches = [(lengths, counts[:, some], pieces.arcs(text, lengths)) for some, text, lengths in grids(words)]
    for _ in range(ROUNDS):
        expected = np.zeros_like(table_)
        for lengths, times, (row, start, end, piece) in batches:
            n, m = len(lengths), int(lengths.max())
            alpha, ahead = forward(n, m, row, start, end, piece, table_)
            back_start, back_end = lengths[row] - end, lengths[row] - start
            beta, behind = forward(n, m, row, back_start, back_end, piece, table_)
            total = _totals(alpha, ahead, lengths)
            share = np.exp(ahead[:, start // SCALED, row] + behind[:, back_start // SCALED, row] - total[:, row])
            share *= alpha[:, start, row] * beta[:, back_start, row] * table_[:, piece] * times[:, row]
            for k in range(len(counts)):
                expected[k] += np.bincount(piece, share[k], pieces.size)
        table_ = (expected + SMOOTHING) / (expected.sum(axis=1)[:, None] + SMOOTHING * pieces.size)
    return table_


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of the text, distinct words, index of the word) of every word of every text, in lower case: runs between
    white space, what is not a letter or mark in them being one space, with a space before. Runs without any are none."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    owner = pc.list_parent_indices(split).to_numpy()
    coded = pc.list_flatten(split).dictionary_encode()
    # the pattern meets each different run once
    letters = pc.utf8_trim_whitespace(pc.replace_substring_regex(coded.dictionary, NOT_LETTERS, " ")).dictionary_encode()
    at = letters.indices.to_numpy().take(coded.indices.to_numpy()) if len(coded) else np.zeros(0, np.int64)
    empty = pc.index(letters.dictionary, pa.scalar("", letters.dictionary.type)).as_py()
    if empty >= 0:
        kept = at != empty
        owner, at = owner[kept], at[kept]
    return owner, pc.binary_join_element_wise(pa.scalar("", letters.dictionary.type), letters.dictionary, " "), at


#: The vocabulary of this worker process, and where it is from.
_latest: list = [None, None]


def pieces_of(vocabulary: str) -> Pieces:
    """The vocabulary, kept for the life of the worker process."""
    if _latest[0] != vocabulary:
        _latest[:] = [vocabulary, Pieces(vocabulary)]
    return _latest[1]


def scores(texts: pa.Array, pieces: Pieces, table_: np.ndarray) -> np.ndarray:
    """Log likelihoods, one row per text; each different word of them is summed once."""
    owner, words, at = words_of(texts)
    logs = log_likelihoods(words, pieces, table_)
    return np.stack([np.bincount(owner, one.take(at), len(texts)) for one in logs], axis=1)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(upto):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, "right")))
        yield a, z
        a = z


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of batches (lang, passage)."""
    for batch in batches:
        for a, z in slices(batch.column(1)):
            langs = batch.column(0).slice(a, z - a).dictionary_encode()
            owner, words, at = words_of(batch.column(1).slice(a, z - a))
            key, n = np.unique(langs.indices.to_numpy()[owner].astype(np.int64) * max(1, len(words)) + at, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key // max(1, len(words)))), words.cast(pa.string()).take(pa.array(key % max(1, len(words)))), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def sample(docs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Labelled rows by language that are not held out, and (lang, passage) of at most SAMPLE different texts of each."""
    labelled = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).collect()  # one row per language
    if not sizes:
        return {}, labelled.select("lang", F.col("text").alias("passage"))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 3 * SAMPLE / max(1, r["different"])))))
    likely = labelled.where(F.pmod(F.xxhash64("h"), F.lit(1_000_003)) / 1_000_003 < share[F.col("lang")])
    # texts of one hash count once, so a text that a third of all rows hold is one row here
    once = likely.groupBy("lang", "h").agg(F.min(F.col("text").substr(F.pmod("h", F.greatest(F.length("text") - PASSAGE + 1, F.lit(1))).cast("int") + 1, F.lit(PASSAGE))).alias("passage"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # about three times SAMPLE rows a language
    return {r["lang"]: r["n"] for r in sizes}, once.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "passage")


def learn(docs: DataFrame, pieces: Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, piece probabilities, log priors."""
    sizes, chosen = sample(docs)
    if not sizes:
        return [], np.zeros((0, pieces.size)), np.zeros(0)
    counted = chosen.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()  # words of the bounded sample
    langs = sorted(set(counted["lang"]))
    if not langs:
        return [], np.zeros((0, pieces.size)), np.zeros(0)
    words = sorted(set(counted["word"]))
    place = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(langs), len(words)))
    counts[[langs.index(x) for x in counted["lang"]], [place[w] for w in counted["word"]]] = counted["n"]
    prior = np.log([sizes[x] for x in langs]) - np.log(sum(sizes.values()))
    return langs, fit(pa.array(words, pa.string()), counts, pieces), prior


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    langs, table_, prior = learn(docs, pieces_of(path))
    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = StructType([source.schema["doc_id"], source.schema["held_out"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for a, z in slices(batch.column(2)):
                texts = batch.column(2).slice(a, z - a)
                pred, score = np.full(z - a, len(langs)), np.zeros(z - a)
                some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)) if langs else []
                if len(some):
                    logs = scores(texts.take(pa.array(some)), pieces, table_) + prior
                    pred[some] = np.argmax(logs, axis=1)
                    score[some] = 1 / np.exp(logs - logs.max(axis=1)[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(names[pred], pa.string()), pa.array(score)], names=schema.names)

    return source.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
