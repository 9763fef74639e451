import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import embedding_dedup, line_dedup, simhash, suffix_dedup
from tests.compare import SF, same


def grouped(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "oNE"), (9006, "a b"), (9007, "É a b c"), (9007, "É a b c"), (9008, "w " * 30000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = simhash.near_duplicates(df.select("doc_id", "text")).collect()
    want = {}
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = grouped(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, f, least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    one_left = simhash.drop_near_duplicates(df, 3)
    assert one_left.columns == df.columns and one_left.count() == len(set(roots))
    assert simhash.near_duplicates(df.limit(0).select("doc_id", "text")).count() == 0


def test_simhash_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 32)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(28, rng.integers(0, 6), replace=False)) for _ in range(700)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df), "u", "v").collect()}
    roots = grouped(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {}
    for f, r in zip(fps, roots, strict=True):
        want.setdefault(r, []).append(simhash._signed(f))
    assert all(got.get(x, x) == min(group) for group in want.values() for x in group)
    big = np.array([base ^ int(x) for x in range(3000)], np.uint64)
    assert len(set(simhash._list_links(big))) == 1


def test_blocks_cover_every_five_positions():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(set(b) <= set(five) for b in simhash.BLOCKS) for five in combinations(range(8), 5))


def plain_line_dedup(rows):
    """The rule in plain code: chunks between least rolling hashes, later ones go, and lines next to them as at the first."""
    def chunks(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % line_dedup.PRIME for x in lines]
        r = [((h[i - 1] if i else 0) * line_dedup.FACTOR + x) % line_dedup.PRIME for i, x in enumerate(h)]
        out, at = [], 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or (i and r[i] < r[i - 1] and r[i] <= r[i + 1]):
                out.append(lines[at : i + 1])
                at = i + 1
        return out

    cut = [(i, chunks(t)) for i, t in rows if t is not None]
    first, anchors = {}, {}
    for d, (_, cs) in sorted(enumerate(cut), key=lambda x: (x[1][0] is not None, x[1][0])):
        for k, c in enumerate(cs):
            if len(c) >= 2 and first.setdefault(tuple(c), (d, k)) != (d, k):
                f, j = first[tuple(c)]
                anchors[d, k] = (cut[f][1][j - 1] if j else [], cut[f][1][j + 1] if j + 1 < len(cut[f][1]) else [])
    out = {}
    for d, (i, cs) in enumerate(cut):
        left = []
        for k, c in enumerate(cs):
            head = next((n for n, (x, y) in enumerate(zip(c, anchors.get((d, k - 1), ((), ()))[1])) if x != y), min(len(c), len(anchors.get((d, k - 1), ((), ()))[1])))
            before = anchors.get((d, k + 1), ((), ()))[0]
            tail = next((n for n, (x, y) in enumerate(zip(reversed(c), reversed(before))) if x != y), min(len(c), len(before)))
            left += [] if (d, k) in anchors else c[head : max(head, len(c) - tail)]
        out[i] = "\n".join(left), sum(map(len, cs)), sum(map(len, cs)) - len(left)
    return out


def test_line_dedup(spark):
    same(line_dedup.op2_lines(spark, SF), line_dedup.dedup_sql())
    lines = "a\nb\nc\nd\ne\nf\ng\nh"
    rows = [(0, None), (1, ""), (None, lines), (2, lines), (2, lines), (3, "x\n" + lines + "\nz"), (4, "\n\n\n\n\n"), (5, "q" * 100_000)]
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_lines int, _row string")
    got = {(r.doc_id, r._row): r for r in line_dedup.dedup(df).collect()}
    want = plain_line_dedup([r for n, r in enumerate(rows) if n != 4])
    assert got[0, "k"].text is None and got[1, "k"].n_lines == 1 and line_dedup.dedup(df).count() == len(rows)
    assert all((got[i, "k"].text, got[i, "k"].n_lines, got[i, "k"].n_removed) == w for i, w in want.items())
    assert want[3][0].startswith("x\n") and want[3][0].endswith("z") and want[3][2] >= 6 and want[2][2] >= 6
    assert line_dedup.dedup(df, counts=False).columns == df.columns
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_passages(spark):
    """Passages in many places: all but the first go, with their ends, and what stands around them stays."""
    rnd = random.Random(8)
    line = lambda: "".join(rnd.choice("abcdefgh") for _ in range(12))
    passages = [[line() for _ in range(n)] for n in (6, 8, 10, 12, 20, 40)]
    rows, whole = [], 0
    for i in range(60):
        parts = [[line() for _ in range(rnd.randrange(0, 6))] for _ in range(3)]
        rows.append((i, "\n".join([*parts[0], *passages[i % 6], *parts[1], *passages[(i * 7 + 3) % 6], *parts[2]])))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(rows)
    own = {x for p in passages for x in p}
    for i, t in rows:
        assert [x for x in t.split("\n") if x not in own] == [x for x in got[i][0].split("\n") if x not in own and x]
    kept = collections.Counter(x for t, _, _ in got.values() for x in t.split("\n") if x in own)
    assert set(kept) == own and sum(n == 1 for n in kept.values()) > 0.8 * len(own)


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 100_000}" for i in range(200_000))
    got = line_dedup.dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    want = plain_line_dedup([(1, text), (2, text)])
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == want and want[2][2] > 199_990


def test_line_dedup_compares_bytes(spark, monkeypatch):
    # with hashes that all collide, chunks that differ stay
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long") if len(c) == 1 else F.crc32(F.concat_ws("|", *c).cast("binary")))
    rows = [(i, f"{i}\n{i + 1}\n{i + 2}\n{i + 3}\n{i + 4}") for i in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup(df).agg({"n_removed": "sum"}).first()[0] == 0


def brute_suffixes(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[p : p + 200] for _, r in raws for p in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, int)
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        k = np.cumsum(gone)[: len(r)] > 0
        left = bytes(np.frombuffer(r, np.uint8)[~k])
        out.append((i, len(r), int(k.sum()), int((np.diff(np.concatenate([[0], k.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_contexts, held", [(4096, 262144), (1, 262144), (4096, 4), (1, 4)])
def test_suffix_dedup(spark, most_contexts, held):
    rnd = random.Random(5)
    w = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    base, p, q, r = w(600), w(250), "q" + "".join(rnd.choice("xyz") for _ in range(198)), "".join(rnd.choice("mno") for _ in range(200))
    rows = [(0, None), (1, ""), (2, base), (2, base), (3, base[:300] + "X" + base[300:]), (4, w(50) + p + w(70)), (5, p + w(400) + p), (6, "1" + q + "2"), (7, "3" + q), (8, r), (9, "4" + r + w(1000)),
            (10, "a" * 1000), (11, "ab" * 90), (12, "ab" * 150), (None, p[:220] + w(100)), (13, w(5000))]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, h string")
    got = sorted((tuple(r)[:5] for r in suffix_dedup.dedup(df, True, most_contexts, held).collect()), key=str)
    assert got == brute_suffixes(rows)
    if held > 4 and most_contexts > 1:
        assert suffix_dedup.dedup(df.limit(0)).count() == 0
        docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
        assert sorted((tuple(x) for x in suffix_dedup.op7_suffixes(spark, SF).collect()), key=str) == brute_suffixes(docs)


def test_long_texts_are_hashed_in_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rnd = random.Random(1)
    text = "".join(rnd.choice("abc") for _ in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["row", "text"])
    found = pa.Table.from_batches(suffix_dedup._survey(iter([batch])))
    at = sorted((p, n) for p, n in zip(found["p"].to_pylist(), found["n"].to_pylist(), strict=True))
    assert sum(n for _, n in at) == 4000 - 199 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for k in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + rng.standard_normal(64) * rng.choice([0.02, 0.12, 0.16])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(len(rows) + i, list(rows[3][1]), rows[3][2]) for i in range(3)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [None] * 64, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float("inf")] * 64, 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows + odd], "vec_id long, embedding array<float>, label int, cid string")
    vectors = np.array([r[1] for r in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    roots = grouped(n, zip(*np.nonzero(np.triu(link)), strict=True))
    want = {i: (int(link[i].sum()), roots[i]) for i in range(n)} | {r[0]: (0, r[0]) for r in odd} | {n + 6: (1, n + 6), n + 7: (1, n + 6)}
    for home, crowd in ((2000, 20000), (3, 10)):
        monkeypatch.setattr(embedding_dedup, "HOME", home)
        monkeypatch.setattr(embedding_dedup, "CROWD", crowd)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
        assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
