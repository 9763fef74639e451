import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing
from tests.compare import SF

SCHEMA = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, docs, tokenizer):
    """Every id of every document lies in one piece, and pieces fill their sequences from offset 0 without a gap."""
    assert rows.columns.tolist() == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want = Counter()
    for i, x in docs:
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want[-1 if i is None else i, zlib.crc32(ids.tobytes()), len(ids)] += 1
    texts = {}
    for i, x in docs:
        texts.setdefault(-1 if i is None else i, np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
    for r in rows.itertuples():
        own = texts[-1 if pd.isna(r.doc_id) else int(r.doc_id)]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    starts = Counter((-1 if pd.isna(i) else int(i), a) for i, a in zip(rows["doc_id"], rows["start"], strict=True))
    for i, own in texts.items():
        parts = sorted({(a, n) for d, a, n in zip(rows["doc_id"], rows["start"], rows["length"], strict=True) if (-1 if pd.isna(d) else int(d)) == i})
        times = {starts[i, a] for a, _ in parts}
        if times == {1}:
            assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert parts[-1][0] + parts[-1][1] == len(own)
    assert rows["length"].sum() == sum(n * k for (_, _, n), k in want.items())
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows["offset"] == rows.groupby("sequence_id")["length"].cumsum() - rows["length"]).all() and (rows["offset"] + rows["length"]).max() <= 2048
    assert sorted(set(rows["sequence_id"])) == list(range(rows["sequence_id"].nunique()))
    return rows["length"].sum(), rows["sequence_id"].nunique()


def test_round_trip(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "  x \n\n y<|endoftext|>"), (None, "z é 日本"), (9004, "w " * 5000), (9005, "a <|endoftext|> b"), (9005, "a <|endoftext|> b"), (9006, "q" * 300_000)]
    df = spark.createDataFrame([(i, x, "k") for i, x in docs], SCHEMA).coalesce(1)
    total, windows = checked(packing.pack(df).toPandas(), docs, tokenizer)
    assert windows == -(-total // 2048)  # one block: nothing but the last window is padded
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows,tokens", [(7, 1 << 23), (65_536, 3000)])
def test_small_blocks(spark, tokenizer, rows, tokens):
    docs = [(i, " ".join("word" for _ in range(i * 37 % 900))) for i in range(60)]
    df = spark.createDataFrame([(i, x, "k") for i, x in docs], SCHEMA).repartition(3)
    spark_conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(spark_conf)
    spark.conf.set(spark_conf, "5")
    try:
        checked(packing.pack(df, rows=rows, tokens=tokens).toPandas(), docs, tokenizer)
    finally:
        spark.conf.set(spark_conf, old)


@pytest.mark.parametrize("words", [3, 205, 1100, 1500, 2047, 2048])
def test_awkward_lengths(spark, tokenizer, words):
    docs = [(i, "w " * words) for i in range(40)]
    total, windows = checked(packing.pack(spark.createDataFrame([(i, x, "k") for i, x in docs], SCHEMA).coalesce(1)).toPandas(), docs, tokenizer)
    assert windows == -(-total // 2048)


def test_sequences_follow_the_order_of_a_table(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('some words ', int(id % 90)) AS text", "'k' AS length").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(str(tmp_path / "docs"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "docs")), rows=100).toPandas()
    first = rows.groupby("sequence_id")["doc_id"].min().sort_index()
    assert (first.diff().dropna() > -110).all() and first.iloc[-1] > 3800


def test_window_is_filled_as_full_as_can_be():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = [rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 9))]
        counts = Counter(lengths)
        room = rnd.randrange(1, 100)
        got = packing.closest(sorted(counts), counts.__getitem__, room)
        best = max(s for k in range(len(lengths) + 1) for c in combinations(lengths, k) if (s := sum(c)) <= room)
        assert sum(k * n for k, n in got.items()) == best and all(counts[k] >= n for k, n in got.items())
    windows = list(packing.minimum_bin_slack([(0, 1500), (1, 300), (2, 300), (3, 240), (4, 8)]))
    assert sorted(windows[0]) == [(0, 0, 1500), (1, 0, 300), (3, 0, 240), (4, 0, 8)] or sorted(windows[0]) == [(0, 0, 1500), (2, 0, 300), (3, 0, 240), (4, 0, 8)]


def test_long_runs_of_one_character(spark, tokenizer):
    docs = [(i, f"x{c * 2_000_000}y") for i, c in enumerate(" \na中")]
    encode = packing.Encoder(packing.default_vocabulary())
    for _, text in docs:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(docs[0][1] + packing.ADDED) == np.array(tokenizer.encode(docs[0][1] + packing.ADDED, add_special_tokens=False).ids, "<u4").tobytes()
    rows = packing.pack(spark.createDataFrame([docs[0], (9, "a")], "doc_id long, text string")).toPandas()
    assert rows["length"].sum() == len(encode(docs[0][1])) // 4 + 1 + 2
