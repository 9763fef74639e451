"""op12: against plain sums over words, with empty sides, ties and odd ids."""

import math
import re
import zlib
from collections import Counter

from sparkloom.llm import importance

SCHEMA = "doc_id long, text string, score long"


def brute(docs, target):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    bucket = lambda w: zlib.crc32(w) % importance.BUCKETS
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, words(x)))
    for x in target:
        t.update(map(bucket, words(x)))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000))))
    rows = []
    for d, x in docs:
        own = [gain(bucket(w)) for w in words(x)]
        weight = sum(own) // len(own) if own else 0
        rows.append([d, len(own), weight, weight + importance.noise(d), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


def test_equals_plain_sums(spark):
    texts = [None, "", "...", "One two É中 Ça-va 3x", "word " * 19, "word " * 20, " é " * 25]
    docs = [(i, texts[i % 7] if i < 14 else f"Target{i % 5} words " * (10 + i % 7) + f"own{i}") for i in range(300)]
    docs += [(None, "target1 null id " * 9), (None, "target1 null id " * 9), (7, "the same id " * 12), (7, "the same id twice " * 12)]
    target = ["target1 words", None, "", "target2 target2 and more words"]
    frame = spark.createDataFrame([(*d, 5) for d in docs], SCHEMA).repartition(4)
    got = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    want = brute(docs, target)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) == 29


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 0)], SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert importance.resample(docs, none).first()["weight"] == brute([(1, "a b")], [])[0][2]
