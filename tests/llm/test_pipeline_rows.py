import random

import pytest

import corpus_pipeline
from sparkloom.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, _row long"


def prose(rnd, n):
    return "\n".join(" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(12)) for _ in range(n))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(4, 9)), "en", f"s{i % 3}") for i in range(40)]
    near = rows[1][1].replace(rows[1][1].split()[30], "changed", 1)
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, "few words", "en", None), (None, prose(rnd, 6), None, None), (None, prose(rnd, 6), None, None), (7, rows[7][1], "en", "s1"), (103, rows[1][1], "en", "s1"), (104, near, "de", "s2"),
             (105, prose(rnd, 900), "en", "s0"), (106, "same words " * 400, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "r", 1) for r in rows], SCHEMA)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {n: [r.doc_id for r in found] for n, found in kept.items()}
    assert {100, 101, 102, 106}.isdisjoint(ids["quality_rules"]) and ids["quality_rules"].count(7) == 2 and ids["quality_rules"].count(None) == 2
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["quality_rules"])) and all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    # of equal rows one stays; the copies' lines went before, so what is left of them is one group
    assert ids["simhash_near_dedup"].count(7) == 1 and ids["simhash_near_dedup"].count(None) == 2 and 105 in ids["simhash_near_dedup"]
    assert set(map(str, ids["source_mixing"])) <= set(map(str, ids["simhash_near_dedup"]))
    encode = packing.Encoder(packing.default_vocabulary())
    packed = kept["sequence_packing"]
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) // 4 + 1 for r in kept["source_mixing"])
    assert sorted({r.sequence_id for r in packed}) == list(range(max(r.sequence_id for r in packed) + 1))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_dedup_links_by_fingerprints(spark):
    """A passage repeated over and over outweighs the rest: fingerprints agree, sets of shingles do not."""
    rnd = random.Random(5)
    again = "one passage that is said over again " * 60
    rows = [(i, again + prose(rnd, 1)) for i in range(4)] + [(10 + i, prose(rnd, 8)) for i in range(4)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x), "r", 1) for i, x in rows], SCHEMA)
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 10, 11, 12, 13]


def test_near_dedup_keeps_one_copy_of_the_texts(spark):
    """Texts written for the fingerprints are deleted once those that stay are written."""
    import os

    from sparkloom.scratch import scratch_dir

    rnd, folder = random.Random(6), scratch_dir(spark)
    rows = [(i, prose(rnd, 4), "en", "s", 1, "r", 1) for i in range(20)]
    docs = spark.createDataFrame([*rows, (50, *rows[3][1:])], SCHEMA)
    before = set(os.listdir(folder))
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    made = [f for f in set(os.listdir(folder)) - before if "_doc" in spark.read.parquet(f"{folder}/{f}").columns]
    assert len(made) == 1 and sorted(r.doc_id for r in out.collect()) == list(range(20))


def test_near_dedup_moves_whole_rows_once(spark):
    """Texts are written down and joined with what stays once for both kinds of near-duplicates."""
    from sparkloom.llm import similar, simhash

    rnd, written, cut = random.Random(8), [], similar.cut
    rows = [(i, prose(rnd, 8), "en", "s", 1, "r", 1) for i in range(12)]
    near = (30, rows[2][1].replace(rows[2][1].split()[9], "changed", 1), *rows[2][2:])
    docs = spark.createDataFrame([*rows, (20, *rows[1][1:]), near], SCHEMA)
    with pytest.MonkeyPatch.context() as patch:
        from sparkloom.llm import common

        for module in (common, similar, simhash):
            patch.setattr(module, "cut", lambda df: written.append(df.columns) or cut(df))
        out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sum("_doc" in columns for columns in written) == 1
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(12))


def test_near_dedup_links_through_dropped_documents(spark):
    """Links of both kinds count together: what a fingerprint drops still links its neighbours by similarity."""
    from sparkloom.llm import simhash
    from tests.llm.test_near_duplicates import grouped
    from tests.llm.test_similar import jaccard, words_set

    rnd, texts = random.Random(2), []
    chain = [f"w{rnd.randrange(10**6)}" for _ in range(110)]
    for _ in range(40):
        chain = list(chain)
        chain[rnd.randrange(110)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(chain))
    sets, prints = [words_set(t) for t in texts], [simhash.fingerprint(t.encode(), 5) for t in texts]
    pairs = [(j, i) for i in range(len(texts)) for j in range(i)]
    alike = [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    close = [p for p in pairs if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3]
    want = sorted(set(grouped(len(texts), alike + close)))
    left = set(grouped(len(texts), close))
    assert len({g for i, g in enumerate(grouped(len(texts), [p for p in alike if left.issuperset(p)])) if i in left}) > len(want)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "r", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == want
