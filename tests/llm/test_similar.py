import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from sparkloom.llm import similar
from tests.llm.test_near_duplicates import grouped


def words_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sets_do_not_depend_on_batches_or_sections(monkeypatch):
    rnd = random.Random(3)
    texts = [None, b"", b" \n", b"One two", b"one  TWO ", "é É".encode(), b"a b c d e", b"a b c d e f", b"x" * 500] + [
        b" ".join(rnd.choice([b"ab", b"c", b"def", b"G"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    got = similar.shingle_sets(texts)
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            assert (len(np.intersect1d(got[a], got[b])) == len(ascii_set(x) & ascii_set(y))) and len(got[a]) == len(ascii_set(x))
    monkeypatch.setattr(similar, "SECTION", 16)
    assert all(np.array_equal(a, b) for a, b in zip(got, similar.shingle_sets(texts), strict=True))
    assert all(np.array_equal(a, similar.shingle_sets([x])[0]) for a, x in zip(got, texts, strict=True))


def ascii_set(x):
    w = (x or b"").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pairs_are_counted_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)] + [np.zeros(0, np.uint64)]
    other = sets[:30] + [s[1:] for s in sets]
    monkeypatch.setattr(similar, "COLUMNS", 7)
    i, j = similar.alike_pairs(sets, other)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(len(sets)) for b in range(len(other)) if similar.alike(sets[a], other[b]) and len(sets[a]) + len(other[b])} | {
        (a, b) for a in range(len(sets)) for b in range(len(other)) if len(sets[a]) + len(other[b]) == 0}


def test_chunks_of_a_bucket_meet_each_other(spark):
    """A group whose pairs mostly miss the bound, in chunks of a few sets each."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for at in rnd.sample(range(120), rnd.randrange(1, 7)):
            copy[at] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [words_set(t) for t in texts]
    linked = [(j, i) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    want = grouped(len(texts), linked)
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    for chunk in (similar.CHUNK, 300):
        marked = rows.mapInArrow(similar._sketches, "_row long, name long, size long, bands array<long>")
        names = {r._row: r.name for r in marked.collect()}
        found = similar.components(similar.links(marked, rows, chunk), "u", "v").collect()
        root = {r.node: r.component for r in found}
        got = [root.get(names[i], names[i]) for i in range(len(texts))]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(texts)), 2)) and 1 < len(set(want)) < 80


def test_near_copies_leave_one(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = [None, "", " \n", "One", "oNE", "a b"]
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(60, 400))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    # a group of many near copies, each a little off the last: linked through others, not all with each other
    chain = [word() for _ in range(150)]
    for _ in range(60):
        chain = list(chain)
        chain[rnd.randrange(150)] = word()
        texts.append(" ".join(chain))
    sets = [words_set(t) for t in texts]
    linked = [(j, i) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(sets[i] != sets[j] for i, j in linked) > 200
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, root string")
    left = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(grouped(len(texts), linked)))
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), "").count() == 0


def test_bound_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert similar.alike(a, a[:8]) and similar.alike(np.arange(10, dtype=np.uint64), a[:8]) and not similar.alike(a, a[:7])
