import random

import pyarrow as pa
import pytest

from sparkloom.llm import suffix_dedup
from tests.llm.test_near_duplicates import brute_suffixes


@pytest.mark.parametrize("last", [1, 3])
def test_every_part_of_a_split_group_is_hot(last):
    names = ["h", "c", "row", "p", "n", "off"]
    rows = [(7, c, c, 0, 1, 0) for c in range(8 + last)] + [(9, 0, 50, 0, 1, 0), (9, 1, 51, 0, 1, 0)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 4]]) for i in range(0, 8, 4)]
    batches.append(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[8:-2]]))
    batches.append(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[-2:]]))
    found = pa.Table.from_batches(suffix_dedup._first_rank(4096, 8)(iter(batches))).to_pylist()
    states = {r["row"]: r["state"] for r in found}
    assert states == {c: suffix_dedup.HOT_ASKS for c in range(8 + last)} | {50: suffix_dedup.ASKS, 51: suffix_dedup.ASKS}


def test_split_group_in_small_batches(spark):
    rnd = random.Random(11)
    w = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = w(250)
    rows = [(i, w(300) + passage + w(300)) for i in range(9)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = sorted((tuple(r)[:5] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), True, 4096, 8).collect()), key=str)
    finally:
        spark.conf.set(key, old)
    assert got == brute_suffixes(rows)
