"""op11: against every window in plain code, on texts made to collide, repeat and fall apart in odd places."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

from sparkloom.llm import phrase_dedup

SCHEMA = "doc_id long, text string, n_words long, kept string"


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    n = phrase_dedup.WORDS
    times = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, y in zip(w, gone, strict=True) if not y]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéß中", k=rng.randint(1, 4)))
    some = lambda n: [word() for _ in range(n)]
    long, passage, other = some(700), some(60), some(35)
    rows = [None, "", " \t\n", "x", " ".join(some(34)), " ".join(other), "  ".join(other) + "\n", " ".join(long), " ".join(long), "\n".join(long[100:400])]
    rows += [" ".join(some(40) + passage + some(rng.randint(0, 50))) for _ in range(12)]  # one passage in changing surroundings
    rows += [" ".join(long[:k] + some(1) + long[k + 1 :]) for k in (0, 33, 35, 340, 699)]  # near copies
    rows += ["a " * 400, "a " * 35, "a " * 34, "a b " * 60, " ".join(["w"] * 36)]  # periods
    rows += [" ".join(long[256 - 34 : 257] + other + long[:35]), "\x00 \x0b\x0c\r" + " ".join(other[::-1])]
    return rows


def test_equals_every_window(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, r, 1, "clash") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in phrase_dedup.dedup(docs).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(w[1] for w in want) > 2000


def test_texts_longer_than_what_is_hashed_at_once(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "PART", 64)
    monkeypatch.setattr(phrase_dedup, "SEGMENT", 200)
    rows = [(r or "").encode() for r in texts()]
    hash_of = {}
    for raw, found in zip(rows, phrase_dedup.word_hashes(rows), strict=True):
        for word, x in zip(raw.split(), found.tolist(), strict=True):
            assert hash_of.setdefault(word, x) == x
    assert len(set(hash_of.values())) == len(hash_of)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([r.decode() for r in rows])], names=["row", "text"])
    windows = Counter()
    for out in phrase_dedup._survey(iter([batch])):
        for row, at in zip(out.column("row").to_pylist(), out.column("at").to_pylist(), strict=True):
            windows.update((row, (at >> 10) + j) for j in range((at >> 5 & 31) + 1))
    assert windows == Counter((i, j) for i, r in enumerate(rows) for j in range(max(0, len(r.split()) - 34)))


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text, 1, ""), (None, text, 1, ""), (1, "alone", 1, ""), (1, None, 1, "")], SCHEMA)
    assert sorted((r["n_words"], r["n_removed"]) for r in phrase_dedup.dedup(docs).collect()) == [(0, 0), (1, 0), (50, 50), (50, 50)]
    assert phrase_dedup.dedup(docs.limit(0)).count() == 0


def test_automata_find_phrases_word_for_word():
    shard = phrase_dedup.Shard([b"a b", b"b c d", b"d d"])
    assert shard.covered(b"x a b c ab a b c d d d".split()).tolist() == [False, True, True, False, False, True, True, True, True, True, True]
    assert not shard.covered([]).any()
