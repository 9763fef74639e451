import collections

import pandas as pd
import pytest

import sparkloom.plans  # noqa: F401
from sparkloom.plans import catalog
from tests.compare import SF, same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    same(df, SQL[name])


def fnv(text, seed):
    h = 2166136261 ^ seed
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def test_sketch_queries(spark):
    """Sketches, pairs and clusters of real sequences against plain code; every query without a statement is held here."""
    assert set(catalog.queries()) - set(SQL) == {"minhash_sketch", "near_duplicates", "duplicate_clusters"}
    tokens = {}
    for key, rows in pd.read_parquet(f"{SF}/lineitem.parquet").groupby("l_suppkey"):
        all_ = [str(int(q)) for q in rows.sort_values(["l_orderkey", "l_linenumber", "l_quantity"])["l_quantity"]]
        tokens |= {f"{key}/{v}": all_[v * 10 :] for v in range(4)}
    seeds = [(2 * i + 1) * 0x9E3779B1 & 0xFFFFFFFF for i in range(64)]
    sketches = {n: [min(fnv(x, s) for x in {" ".join(t[i : i + 3]) for i in range(len(t) - 2)}) for s in seeds] for n, t in tokens.items() if len(t) >= 40}
    got = {r.name: (r.lanes, r.lane0, r.lane63) for r in catalog.queries()["minhash_sketch"](spark, SF).collect()}
    assert {n: g for n, g in got.items() if g[1] is not None} == {n: (64, s[0], s[63]) for n, s in sketches.items()}
    like = {(a, b): sum(x == y for x, y in zip(sketches[a], sketches[b])) / 64 for a in sketches for b in sketches if a < b}
    want = {(a, b): s for (a, b), s in like.items() if s >= 0.8}
    distinct = {}
    for n in sorted(sketches):
        distinct.setdefault(tuple(sketches[n]), n)
    reps = set(distinct.values())
    pairs = {(r.a, r.b): r.similarity for r in catalog.queries()["near_duplicates"](spark, SF).collect()}
    assert pairs == {p: s for p, s in want.items() if set(p) <= reps} and any(s < 1 for s in pairs.values())
    root = {n: n for n in sketches}
    for _ in root:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    sizes = collections.Counter(root.values())
    clusters = {r.name: (r.anchor, r.members) for r in catalog.queries()["duplicate_clusters"](spark, SF).collect()}
    assert clusters == {n: (r, sizes[r]) for n, r in root.items() if sizes[r] > 1} and clusters


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
