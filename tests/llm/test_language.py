import base64
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(word: bytes, p: dict) -> list[float]:
    """Logarithms of the sums over all segmentations of every prefix; sums are kept as logarithms."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        found = [logs[start] + math.log(p[word[start:end]]) for start in range(end) if p.get(word[start:end])]
        top = max(found)
        logs.append(top + math.log(sum(math.exp(x - top) for x in found)))
    return logs


def own(vocabulary):
    with open(vocabulary, "rb") as lines:
        return sorted(x for x in {base64.b64decode(y.split()[0]) for y in lines} if language.CAN_MATCH.fullmatch(x))


def test_forward_sums_all_segmentations(vocabulary):
    pieces, found = language.Pieces(vocabulary), own(vocabulary)
    assert pieces.size == len(found) and max(map(len, found)) > 12
    table = np.random.default_rng(0).random((2, pieces.size)) * 1e-3
    words = [" the", " schön", "x", " internationalization", " " + "abcdefghij" * 20, " " + "日本語の文章" * 30, " a b", " internationalisation" * 5]
    got = language.log_likelihoods(pa.array(words), pieces, table)
    for k in range(2):
        p = dict(zip(found, table[k], strict=True))
        assert np.allclose(got[k], [brute(w.encode(), p)[-1] for w in words])


def test_fit_is_expectation_maximisation(tmp_path, monkeypatch):
    parts = [b"a", b"b", b"c", b" ", b"ab", b"bc", b" a", b"abc", b"caab"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % i for i, x in enumerate(parts)))
    pieces, found = language.Pieces(str(tmp_path / "v")), sorted(parts)
    words, counts = [" abc", " caabab", " bcab", " " + "abc" * 30], np.array([[3.0, 1, 2, 1], [0, 5, 1, 2]])
    got = language.fit(pa.array(words), counts, pieces)
    for k in range(2):
        p = dict.fromkeys(found, 1 / len(found))
        for _ in range(language.ROUNDS):
            expected = dict.fromkeys(found, 0.0)
            for word, times in zip(words, counts[k], strict=True):
                w = word.encode()
                ahead, behind = brute(w, p), brute(w[::-1], {x[::-1]: y for x, y in p.items()})[::-1]
                for a in range(len(w)):
                    for z in range(a + 1, len(w) + 1):
                        if w[a:z] in p:
                            expected[w[a:z]] += times * math.exp(ahead[a] + behind[z] - ahead[-1]) * p[w[a:z]]
            total = sum(expected.values()) + language.SMOOTHING * len(found)
            p = {x: (y + language.SMOOTHING) / total for x, y in expected.items()}
        assert np.allclose(got[k], [p[x] for x in found])


def test_words_are_lower_case_letters():
    owner, words, at = language.words_of(pa.array(["The cat, THE", None, " ", "12 a-b", "ÉTÉ\u00a0x\u3000y"]))
    assert [(o, words[i].as_py()) for o, i in zip(owner.tolist(), at.tolist(), strict=True)] == [(0, " the"), (0, " cat"), (0, " the"), (3, " a b"), (4, " été"), (4, " x"), (4, " y")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.op10_language(spark, "/root/testdata/sf0.01").collect()}
    wrong = out = 0
    for r in docs.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if got[r.doc_id].held_out:
            out += 1
            wrong += got[r.doc_id].lang_pred != r.lang
    assert out > 200 and wrong <= 0.01 * out


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", "en"), (None, "the cat", None), (5, "x" * 100_000, None), (5, "x" * 100_000, None)], DOCS)
    rows = language.identify(odd.withColumn("score", F.lit("own"))).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows} == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), None: ("und", 0.0), 5: ("und", 0.0)} and len(rows) == 6
    assert language.identify(odd.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)])
def test_learning_does_not_look_at_doc_id(spark, doc_id):
    """Null or constant ids, and one text that most rows hold: all the same sample."""
    words = {"en": "the cat and the dog went over the hill", "de": "der hund und die katze gehen schnell nach hause"}
    rows = [(doc_id, f"{words[x]} {'abcdefghij'[i % 10] * 3}", x) for i in range(40) for x in words] + [(doc_id, words["en"], "en")] * 500
    got = language.identify(spark.createDataFrame([*rows, (doc_id, "die katze und der hund", None)], DOCS)).collect()
    assert sum(r.lang_pred == "en" for r in got) == 540 and sum(r.lang_pred == "de" for r in got) == 41 and not any(r.held_out for r in got)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang")
    sizes, chosen = language.sample(docs)
    found = [tuple(r) for r in chosen.collect()]
    assert len(found) == len(set(found)) == 40 and set(sizes) == {"aa", "bb"} and sum(sizes.values()) < 3000
