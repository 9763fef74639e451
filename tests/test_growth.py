"""Plans that must not grow into the driver or into one task, whatever the files' sizes say."""

import pytest

import sparkloom.plans  # noqa: F401
from sparkloom.plans import catalog
from tests.compare import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rule_duplicate", "unexpandable_spreads", "rule_prop_invalid_typed", "token_references", "legal_values"])
def test_growing_sides_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(catalog.queries()[name](spark, SF))


def test_scripts_are_dealt_over_tasks(spark):
    from sparkloom.plans import typed

    assert typed.scripts(spark, SF).rdd.getNumPartitions() == typed.style_files(spark, SF).rdd.getNumPartitions() == 8


def test_colours_are_dealt_over_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(catalog.queries()["nearest_color"](spark, SF))


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_of_components(spark, tmp_path, seed):
    """Few and many near entries, ids that fall and rise with the balance, equal balances, nulls; no pair of all rows."""
    import random

    from tests.compare import same

    rng = random.Random(seed)
    own = [(k, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 1000.0, 2000.0, 999.99, -0.01, 50_000.0, *(round(rng.uniform(-1000, 4000), 2) for _ in range(20))])) for k in range(400)]
    kits = [(k, rng.choice([None, 0, 1, 1, 1, 2]), rng.choice([None, 2000.0, 0.0, float(k * 17), 4000.0 - k * 11, round(rng.uniform(-1000, 4000), 2)]), "s") for k in range(rng.choice([9, 300]))]
    kits += [(1000, 3, 49_500.0, "s"), (1001, 4, 51_000.0, "s")]
    spark.createDataFrame(own, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(kits, "s_suppkey long, s_nationkey int, s_acctbal double, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.queries()["component_score"](spark, str(tmp_path))
    assert "NestedLoop" not in plan(found)
    same(found, catalog.oracle_sql()["component_score"], str(tmp_path))


def test_more_findings_than_four_digits(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.compare import same

    parts = spark.read.parquet(f"{SF}/part.parquet").crossJoin(spark.range(700).withColumnRenamed("id", "n"))
    parts.withColumn("p_partkey", F.col("n") * 200 + F.col("p_partkey")).drop("n").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["rule_findings"](spark, str(tmp_path))
    assert found.count() > 9999
    same(found, catalog.oracle_sql()["rule_findings"], str(tmp_path))


def test_links_are_resolved_once_for_all_rounds(spark, monkeypatch):
    from sparkloom.operators import kit

    seen, closure = [], kit.closure
    monkeypatch.setattr(kit, "closure", lambda seeds, edges: seen.append(plan(edges)) or closure(seeds, edges))
    catalog.queries()["kit_closure"](spark, SF)
    assert "Scan parquet" in seen[0] and "Join" not in seen[0] and "Generate" not in seen[0]


def test_modules_meet_their_files_under_every_candidate(spark):
    from sparkloom.sources import configs

    names = ["a", "a.ts", "a/index.ts", "a.ts/index.js", "index.ts", "b.tsx", "b.js", "b/index.jsx", "c.ts.ts", "c/index.ts.ts", "d/index.cjs", ".ts", "e.mjs", None]
    asked = [f"./{x}" for x in ("a", "a.ts", "a/index", "b", "b.js", "b/index", "c", "c.ts", "c/index.ts", "d", "d/index", "e", "e.m", "index", ".")]
    files, used = spark.createDataFrame([(n,) for n in [*names, "b.js"]], "file string"), spark.createDataFrame([("x.ts", s) for s in asked], "file string, specifier string")
    got = configs.resolve_modules(used, files, {})
    assert "posexplode" not in plan(got)
    want = {s: next((s[2:] + c for c in configs.CANDIDATES if s != "./." and s[2:] + c in names), None) for s in asked}
    want["./."] = next((c for c in configs.CANDIDATES if c in names), None)
    assert {r.specifier: r.target for r in got.collect()} == want and len(set(want.values())) > 9


@pytest.mark.parametrize("name", ["tokens_extracted", "token_counts", "token_scales", "token_lookup", "token_diagnostics"])
def test_trees_are_opened_in_one_pass_and_dealt(spark, monkeypatch, name):
    """One table a step instead of one a level, tier and mode; values without references are never moved again."""
    from sparkloom.operators import tokens

    made, cut = [], tokens.cut
    monkeypatch.setattr(tokens, "cut", lambda df: made.append(plan(df)) or cut(df))
    catalog.queries()[name](spark, SF)
    assert len(made) <= 7 and made[0].count("Scan parquet") == 1 and "REPARTITION_BY_NUM" in made[0] and not any("Broadcast" in p for p in made[:6])


def test_variables_of_stylesheets_are_not_broadcast(spark, monkeypatch):
    from sparkloom.sources import scss

    made, cut = [], scss.cut
    monkeypatch.setattr(scss, "cut", lambda df: made.append(plan(df)) or cut(df))
    found = plan(catalog.queries()["scss_variables"](spark, SF))
    assert "Broadcast" not in found and not any("Broadcast" in p for p in made[3:])
