"""op13: against spans of both tokenizers over the whole text, with both run without any cut."""

import hashlib
import random
from collections import Counter

import pytest

from sparkloom.llm import alignment

ODD = [
    None, "", " ", "  ", "a", "a b", "a  b ", " lead", "\nline", "a\n\n b\r\nc;\r\nd\t e", "x;\r", "say <|endoftext|> now", "</s> <unk> <0x41>", "▁", "a▁b c", "a\x00b", "　wide space end", "ﬁ ½ Å é",
    "it's we'll 123 45,6", "日本語 テキスト", "\U0001f600 \U0001f468‍\U0001f469", "a" * 3000, " " * 7000, "\n" * 6000 + "x", "\x1c\x1d x\x85y", "the the the",
]


def texts():
    rng = random.Random(3)
    alphabet = ["the", "of", "ing", " ", " ", "\n", "  ", "\r", "é", "▁", "'s", "12", ".", "中", "\t", "<|endoftext|>", "Zq"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(150)]


@pytest.fixture(scope="module")
def sides():
    a, b = alignment.default_paths()
    return alignment.ByteLevel(a), alignment.Pieces(b)


def brute(rows, sides):
    a_side, b_side = sides
    found, times = [], Counter()
    for text in rows:
        a = a_side.whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        pieces = [[a_side.bytes[i] for i in a], [b_side.bytes[i] for i in b]]
        if not text or any(b"".join(p) != raw for p in pieces):
            found.append((0, 0, 0, [], ""))
            continue
        owner = [[i for i, p in enumerate(side) for _ in p] for side in pieces]  # token of each byte
        links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(*owner, strict=True))]
        ends = [{sum(map(len, side[: k + 1])): k + 1 for k in range(len(side))} for side in pieces]
        shared = [0, *sorted(set(ends[0]) & set(ends[1]))]
        at = [(ends[0].get(x, 0), ends[1].get(x, 0)) for x in shared]
        groups = [(a[p:q], b[r:s]) for (p, r), (q, s) in zip(at, at[1:], strict=False)]
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        times.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    best = Counter()
    for (_, y), n in times.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(links), sum(times[x] == best[x[1]] for x in links), sum(times[x] for x in links), sha) for na, nb, ng, links, sha in found]


@pytest.mark.parametrize(("rows", "chunks"), [(alignment.ROWS, alignment.CHUNKS), (7, 60)])
def test_equals_spans(spark, sides, rows, chunks):
    given = texts()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(given)], "doc_id long, text string, n_a long, block string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, rows=rows, chunks=chunks).collect()}
    assert [got[i] for i in range(len(given))] == brute(given, sides)


def test_pair_counts_empty_and_repeated(spark, sides):
    docs = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (2, None)], "doc_id long, text string")
    links = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.pair_counts(docs).collect()}
    assert links and set(links.values()) == {(2, True)}
    assert alignment.align(docs.limit(0)).count() == 0


def test_transducer_tracks_the_side_that_leads():
    t = alignment.Transducer({0: b"ab", 1: b"c", 2: b"x"}, {0: b"a", 1: b"bc", 2: b"abc"})
    assert t.align([0, 1], [0, 1]) == ([(0, 2, 0, 2)], [(0, 0), (0, 1), (1, 1)])
    assert t.align([0, 1], [2]) == ([(0, 2, 0, 1)], [(0, 2), (1, 2)])
    assert t.align([2], [0]) is None and t.align([0], [0]) is None and t.align([0, 1], [2, 0]) is None
    assert t.align([], []) == ([], [])


def test_chunks_are_aligned_once_for_all_blocks():
    """A second block takes over what a first one aligned; chunks met long ago are aligned anew, alike."""
    aligner = alignment.Aligner(*alignment.default_paths())
    ran, run = [], aligner._run
    aligner._run = lambda texts: ran.append(texts) or run(texts)
    blocks = [alignment._Block(aligner) for _ in range(2)]
    for block in blocks:
        block.add("one two three two")
    assert ran == [[" one", " two", " three"]] and blocks[0].hashes == blocks[1].hashes and blocks[0].codes == blocks[1].codes
    aligner.lately, aligner.before = {}, {}
    again = alignment._Block(aligner)
    again.add("one two three two")
    assert len(ran) == 2 and again.hashes == blocks[0].hashes and again.written == blocks[0].written


def test_new_chunks_are_tokenized_end_to_end():
    """Plain chunks in one call of each tokenizer give what they give one by one; chunks that end in white space are apart."""
    aligner = alignment.Aligner(*alignment.default_paths())
    texts = [" the", "\ncat", " Übermaß,", " ###", "  two", " 12ab", " last "]
    calls, short = [], aligner.a.short.encode_ordinary
    aligner.a.ids = lambda text: calls.append(text) or short(text)
    together = list(aligner._run(texts))
    assert calls == [" last "]
    assert together == [next(iter(aligner._run([t]))) for t in texts]
