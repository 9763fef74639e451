"""Roll-ups over the driver tables: impact, problems, counts, shares, scores, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.numbers import health_score, ratio, round_half_up
from sparkloom.operators import aggs, overlay
from sparkloom.plans.catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("impact_rollup", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS impact_key, l_suppkey FROM lineitem),
s AS (SELECT impact_key, count(*) AS occurrences, count(DISTINCT l_suppkey) AS files FROM f GROUP BY impact_key)
SELECT l_orderkey, l_linenumber, impact_key, occurrences, files FROM f JOIN s USING (impact_key)""")
def impact_rollup(spark, sf):
    f = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("impact_key"), "l_suppkey")
    return aggs.impact(f, "impact_key", "l_suppkey").select("l_orderkey", "l_linenumber", "impact_key", "occurrences", "files").orderBy("l_orderkey", "l_linenumber")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query("count_zero_filled", f"""
WITH k AS (SELECT unnest({PRIORITIES}) AS o_orderpriority), c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, coalesce(n, 0)::BIGINT AS n FROM k FULL JOIN c USING (o_orderpriority)""")
def count_zero_filled(spark, sf):
    return aggs.zero_filled(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES)


@query("severity_grouping_sets", """
SELECT coalesce(event_type, '*') AS event_type, coalesce((user_id % 10)::BIGINT, -1) AS shard, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_large
FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())""")
def severity_grouping_sets(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 10).alias("shard"), "value")
    return e.groupingSets([[F.col("event_type")], [F.col("shard")], []], "event_type", "shard").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large")).select(
        F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce("shard", F.lit(-1)).cast("long").alias("shard"), "n", "n_large")


RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END"


@query("problems", f"""
WITH f AS (SELECT *, {RANK} AS rank, user_id % 25 AS key FROM events)
SELECT key AS problem, arg_min(event_id, (rank, ts, event_id)) AS lead, min(rank)::INT AS worst, count(*) AS occurrences, count(DISTINCT user_id) AS files,
       bool_and(value > 1) AS every_large, arg_min(event_id, event_id) FILTER (WHERE value > 90) AS first_large,
       (12 * count(*) FILTER (WHERE rank = 0) + 4 * count(*) FILTER (WHERE rank = 1) + count(*) FILTER (WHERE rank = 2))::BIGINT AS weight
FROM f GROUP BY key""")
def problems(spark, sf):
    f = table(spark, sf, "events").withColumn("rank", F.expr(RANK)).withColumn("problem", F.col("user_id") % 25)
    many = lambda r: F.count_if(F.col("rank") == r)
    return f.groupBy("problem").agg(
        F.min_by("event_id", F.struct("rank", "ts", "event_id")).alias("lead"), F.min("rank").alias("worst"), F.count("*").alias("occurrences"),
        F.countDistinct("user_id").alias("files"), F.bool_and(F.col("value") > 1).alias("every_large"),
        F.min(F.when(F.col("value") > 90, F.col("event_id"))).alias("first_large"), (12 * many(0) + 4 * many(1) + many(2)).alias("weight")).orderBy(
        F.desc("weight"), F.desc("occurrences"), "problem")


@query("file_groups", """
SELECT l_orderkey, count(*) AS findings, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(*) FILTER (WHERE l_returnflag = 'A') AS warnings,
       count(*) FILTER (WHERE l_returnflag = 'N') AS infos, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::INT AS worst,
       (3.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_returnflag = 'A') + 0.25::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'N'))::DOUBLE AS weight,
       count(*) FILTER (WHERE l_discount > 0.05) AS fixable FROM lineitem GROUP BY l_orderkey""")
def file_groups(spark, sf):
    r = lambda x: F.count_if(F.col("l_returnflag") == x)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("findings"), r("R").alias("errors"), r("A").alias("warnings"), r("N").alias("infos"),
        F.min(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)).alias("worst"),
        (3.0 * r("R") + r("A") + 0.25 * r("N")).alias("weight"), F.count_if(F.col("l_discount") > 0.05).alias("fixable"))


@query("facet_counts", """
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%URGENT' AND o_totalprice > 1000 GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY 2
UNION ALL SELECT 'year', extract(year FROM o_orderdate)::VARCHAR, count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '%URGENT' GROUP BY 2""")
def facet_counts(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return aggs.facet_counts(o, {"status": ("o_orderstatus", F.col("o_orderstatus") == "O"), "priority": ("o_orderpriority", F.col("o_orderpriority").endswith("URGENT")), "year": ("year", F.col("o_totalprice") > 1000)})


@query("matches_filters", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000
AND contains(lower(concat_ws(' ', o_orderkey::VARCHAR, o_orderpriority, o_orderstatus)), 'high')""")
def matches_filters(spark, sf):
    text = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"))
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F") & F.col("o_totalprice").between(1000, 200000) & text.contains("high")).select("o_orderkey", "o_orderstatus")


@query("clean_entities", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def clean_entities(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("clean_files_count", "SELECT count(*) AS clean FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def clean_files_count(spark, sf):
    bad = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(bad, "s_suppkey", "left_anti").agg(F.count("*").alias("clean"))


@query("adoption_ratio", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS own, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS total,
CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'view')) = 0 THEN 1.0::DOUBLE
 ELSE count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*) FILTER (WHERE event_type IN ('purchase', 'view')) END AS adoption FROM events GROUP BY user_id""")
def adoption_ratio(spark, sf):
    own, total = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "view"))
    return table(spark, sf, "events").groupBy("user_id").agg(own.alias("own"), total.alias("total")).withColumn("adoption", ratio(F.col("own").cast("double"), F.col("total")))


@query("health_score", """
WITH f AS (SELECT d.source, sum(CASE WHEN l.toxic = 1 THEN 3.0 WHEN l.quality = 0 THEN 1.0 ELSE 0.25 END)::DOUBLE AS weight, count(*) AS files,
 count(*) FILTER (WHERE l.quality = 1)::DOUBLE / count(*) AS adoption, count(*) FILTER (WHERE l.toxic = 0)::DOUBLE / count(*) AS coverage
 FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source)
SELECT source, files, floor(100 * (0.5::DOUBLE * (1 - least(1.0::DOUBLE, weight / files / 12)) + 0.3::DOUBLE * adoption + 0.2::DOUBLE * coverage) + 0.5)::BIGINT AS score FROM f""")
def health(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    sums = d.groupBy("source").agg(
        F.sum(F.when(F.col("toxic") == 1, 3.0).when(F.col("quality") == 0, 1.0).otherwise(0.25)).alias("weight"), F.count("*").alias("files"),
        (F.count_if(F.col("quality") == 1).cast("double") / F.count("*")).alias("adoption"), (F.count_if(F.col("toxic") == 0).cast("double") / F.count("*")).alias("coverage"))
    return sums.select("source", "files", health_score(F.col("weight"), F.col("files"), F.col("adoption"), F.col("coverage")).alias("score"))


@query("largest_remainder", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS x FROM c),
r AS (SELECT *, floor(x)::BIGINT AS f, row_number() OVER (ORDER BY x - floor(x) DESC, o_orderpriority) AS r FROM x)
SELECT o_orderpriority, n, (f + CASE WHEN r <= 100 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS percent FROM r""")
def largest_remainder(spark, sf):
    return aggs.largest_remainder(table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n")


@query("outlier_frequency", """
WITH c AS (SELECT floor(l_extendedprice / 2500)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, (sum(n) OVER ())::BIGINT AS total FROM c)
SELECT bucket, n, total, total >= 12 AND n <= greatest(2, floor(total * 0.05::DOUBLE)) AS outlier FROM t""")
def outlier_frequency(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 2500).alias("bucket")).agg(F.count("*").alias("n"))
    t = c.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a value
    return t.withColumn("outlier", (F.col("total") >= 12) & (F.col("n") <= F.greatest(F.lit(2), F.floor(F.col("total") * F.lit(0.05)))))


@query("top_k_per_group", """
SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3""")
def top_k_per_group(spark, sf):
    return aggs.top_k_per_key(table(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("context_window", """
SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), ',') AS context FROM events""")
def context_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 4)
    return table(spark, sf, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), ",").alias("context"))


@query("finding_id", """
SELECT o_orderkey, printf('f_%04d', row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey)) AS id FROM orders""")
def finding_id(spark, sf):
    numbered = aggs.global_number(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_custkey", "o_orderkey"])
    return numbered.select("o_orderkey", F.format_string("f_%04d", "number").alias("id"))


@query("mode_source", """
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM c) WHERE r = 1""")
def mode_source(spark, sf):
    return aggs.mode_per_key(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("component_usage", """
WITH h AS (SELECT l_suppkey, l_returnflag AS prop, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT l_suppkey, count(*) AS usages, count(DISTINCT l_orderkey) AS files, count(*) FILTER (WHERE l_discount > 0.08) AS overrides FROM lineitem GROUP BY 1)
SELECT l_suppkey, usages, files, overrides, string_agg(prop || '.' || value || '=' || n, ',' ORDER BY prop, value) AS histogram FROM u JOIN h USING (l_suppkey) GROUP BY ALL""")
def component_usage(spark, sf):
    li = table(spark, sf, "lineitem")
    h = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linestatus", "n"))), lambda x: F.concat(x["l_returnflag"], F.lit("."), x["l_linestatus"], F.lit("="), x["n"].cast("string"))), ",").alias("histogram"))
    u = li.groupBy("l_suppkey").agg(F.count("*").alias("usages"), F.countDistinct("l_orderkey").alias("files"), F.count_if(F.col("l_discount") > 0.08).alias("overrides"))
    return u.join(h, "l_suppkey")


@query("token_usage", """
WITH k AS (SELECT props, unnest(json_keys(props)) AS k FROM events)
SELECT token, count(*) AS n FROM (SELECT event_type AS token FROM events UNION ALL SELECT json_extract_string(props, '$."' || k || '"') FROM k) WHERE token IS NOT NULL GROUP BY token""")
def token_usage(spark, sf):
    """References over two channels: the type, and every value of every key of the properties."""
    e = table(spark, sf, "events")
    values = e.select(F.explode(F.map_values(F.from_json("props", "map<string,string>"))).alias("token"))
    return e.select(F.col("event_type").alias("token")).unionByName(values).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))


@query("custom_components", """
SELECT p_brand, max_by_key AS p_partkey, elements, CASE WHEN n > 60 THEN 'reused' WHEN elements > 45 THEN 'large' ELSE 'single' END AS verdict FROM (
 SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS max_by_key, max(p_size) AS elements, count(*) AS n FROM part GROUP BY p_brand)""")
def custom_components(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(F.col("p_size"), (-F.col("p_partkey")).alias("k"))).alias("p_partkey"), F.max("p_size").alias("elements"), F.count("*").alias("n"))
    return g.select("p_brand", "p_partkey", "elements", F.when(F.col("n") > 60, "reused").when(F.col("elements") > 45, "large").otherwise("single").alias("verdict"))


BREAKDOWN = "CASE WHEN event_type = 'error' THEN 'native' WHEN value > 75 THEN 'kit' WHEN value > 50 THEN 'foreign' WHEN user_id % 2 = 0 THEN 'custom' ELSE 'unknown' END"


@query("element_breakdown", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {BREAKDOWN} = '{k}') AS {k}" for k in ("native", "kit", "foreign", "custom", "unknown")) + " FROM events")
def element_breakdown(spark, sf):
    return table(spark, sf, "events").agg(*(F.count_if(F.expr(BREAKDOWN) == k).alias(k) for k in ("native", "kit", "foreign", "custom", "unknown")))


@query("group_a11y", """
SELECT o_custkey, count(*) AS occurrences, count(*) FILTER (WHERE o_totalprice > 100000) AS fixable, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS criteria FROM orders GROUP BY o_custkey""")
def group_a11y(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("occurrences"), F.count_if(F.col("o_totalprice") > 100000).alias("fixable"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("criteria"))


@query("criteria_count", "SELECT o_orderstatus, count(DISTINCT w) AS criteria FROM (SELECT o_orderstatus, unnest(string_split(o_orderpriority, '-')) AS w FROM orders) GROUP BY 1")
def criteria_count(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", F.explode(F.split("o_orderpriority", "-")).alias("w")).groupBy("o_orderstatus").agg(F.countDistinct("w").alias("criteria"))


SECTIONS = [("1-URGENT", "names"), ("2-HIGH", "focus"), ("3-MEDIUM", "focus")]


@query("sections", f"""
WITH s AS (SELECT unnest({[a for a, _ in SECTIONS]}) AS p, unnest({[b for _, b in SECTIONS]}) AS section)
SELECT coalesce(section, 'other') AS section, count(*) AS n, count(DISTINCT o_custkey) AS files FROM orders LEFT JOIN s ON o_orderpriority = p GROUP BY 1""")
def sections(spark, sf):
    s = spark.createDataFrame(SECTIONS, "o_orderpriority string, section string")
    return table(spark, sf, "orders").join(F.broadcast(s), "o_orderpriority", "left").groupBy(F.coalesce("section", F.lit("other")).alias("section")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("files"))


@query("variant_share", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderstatus) * 10000 + 0.5) / 10000 AS share FROM orders GROUP BY 1, 2")
def variant_share(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.withColumn("share", round_half_up(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 4))


@query("dimension_histogram", "SELECT p_size AS px, count(*) AS n FROM part GROUP BY 1")
def dimension_histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("px")).agg(F.count("*").alias("n"))


@query("top_tokens", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 12")
def top_tokens(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(12)


@query("top_problems", """
SELECT o_custkey, sum(CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'P' THEN 1.0 ELSE 0.25 END)::DOUBLE AS weight, count(*) AS occurrences FROM orders GROUP BY 1 ORDER BY weight DESC, occurrences DESC, o_custkey LIMIT 5""")
def top_problems(spark, sf):
    w = F.when(F.col("o_orderstatus") == "F", 3.0).when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.25)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(w).alias("weight"), F.count("*").alias("occurrences")).orderBy(F.desc("weight"), F.desc("occurrences"), "o_custkey").limit(5)


@query("spacing_scale", """
WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, n::DOUBLE / sum(n) OVER () AS share FROM c)
SELECT count(*) FILTER (WHERE share >= 0.01) AS steps, floor(sum(n) FILTER (WHERE share >= 0.01)::DOUBLE / sum(n) * 1000 + 0.5) / 1000 AS coverage,
 floor(sum(n) FILTER (WHERE p_size % 4 = 0)::DOUBLE / sum(n) * 1000 + 0.5) / 1000 AS on_grid FROM s""")
def spacing_scale(spark, sf):
    c = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    s = c.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))
    part = lambda test: round_half_up(F.sum(F.when(test, F.col("n"))).cast("double") / F.sum("n"), 3)
    return s.agg(F.count_if(F.col("share") >= 0.01).alias("steps"), part(F.col("share") >= 0.01).alias("coverage"), part(F.col("p_size") % 4 == 0).alias("on_grid"))


@query("typography_tuples", """
SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS size, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS weight, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS height FROM lineitem GROUP BY 1""")
def typography_tuples(spark, sf):
    at = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(at(1).alias("size"), at(2).alias("weight"), at(3).alias("height"))


@query("scales", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS steps FROM part WHERE p_size <= 32 GROUP BY 1")
def scales(spark, sf):
    return table(spark, sf, "part").where("p_size <= 32").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")), ",").alias("steps"))


@query("collisions", "SELECT c_mktsegment, c_nationkey, count(*) AS owners FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def collisions(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("owners")).where("owners > 1")


@query("diagnostics", """
SELECT name, count(*) AS n, array_to_string(list_sort(list(k))[1:10], ',') AS samples FROM (
 SELECT 'negative balance' AS name, c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'large balance', c_custkey FROM customer WHERE c_acctbal > 9000) GROUP BY 1""")
def diagnostics(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    found = [("negative balance", c.where("c_acctbal < 0")), ("no orders", c.join(o, "c_custkey", "left_anti")), ("large balance", c.where("c_acctbal > 9000"))]
    rows = None
    for name, rule in found:
        one = rule.select(F.lit(name).alias("name"), F.col("c_custkey").alias("k"))
        rows = one if rows is None else rows.unionByName(one)
    # the ten smallest per check by rank, not a list of all
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    least = aggs.top_k_per_key(rows, ["name"], [F.asc("k")], 10).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("samples"))
    return counts.join(least, "name")


CONFIG = [("event.error", "off"), ("event", "warning"), ("event.purchase/big", "error"), ("category:growth", "info")]


def _event_findings(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.when(F.col("event_type") == "signup", "growth.").otherwise("event."), F.col("event_type")).alias("rule"),
        F.when(F.col("value") > 50, "big").otherwise("small").alias("subkind"), F.when(F.col("event_type") == "signup", "growth").otherwise("usage").alias("category"), F.lit("candidate").alias("severity"))


_FINDINGS = """f AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'growth.' ELSE 'event.' END || event_type AS rule, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS subkind,
 CASE WHEN event_type = 'signup' THEN 'growth' ELSE 'usage' END AS category FROM events),
l AS (SELECT *, CASE WHEN rule || '/' || subkind = 'event.purchase/big' THEN 'error' WHEN rule = 'event.error' THEN 'off' WHEN rule LIKE 'event.%' THEN 'warning' WHEN category = 'growth' THEN 'info' ELSE 'on' END AS level FROM f)"""


@query("config_overlay", f"WITH {_FINDINGS} SELECT event_id, rule, CASE WHEN level = 'on' THEN 'candidate' ELSE level END AS severity FROM l WHERE level <> 'off'")
def config_overlay(spark, sf):
    return overlay.apply_config(_event_findings(spark, sf), spark.createDataFrame(CONFIG, "key string, level string")).select("event_id", "rule", "severity")


@query("tally", f"WITH {_FINDINGS} SELECT coalesce(category, '*') AS category, coalesce(rule, '*') AS rule, count(*) FILTER (WHERE level <> 'off') AS visible, count(*) FILTER (WHERE level = 'off') AS hidden FROM l GROUP BY GROUPING SETS ((), (category), (rule))")
def tally(spark, sf):
    t = overlay.tally(_event_findings(spark, sf), spark.createDataFrame(CONFIG, "key string, level string"))
    return t.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("rule", F.lit("*")).alias("rule"), "visible", "hidden")


@query("files_by_extension", "SELECT regexp_extract(url, '(\\.[a-z]+)(?:[?#].*)?$', 1) AS extension, count(*) AS n FROM pages GROUP BY 1")
def files_by_extension(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"(\.[a-z]+)(?:[?#].*)?$", 1).alias("extension")).agg(F.count("*").alias("n"))


@query("kit_gaps", "SELECT regexp_extract(url, '//([^./]+)\\.', 1) AS value, regexp_extract(url, '/(en|fr|de|es)/', 1) AS role, count(*) AS n FROM pages GROUP BY 1, 2")
def kit_gaps(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"//([^./]+)\.", 1).alias("value"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("role")).agg(F.count("*").alias("n"))


@query("positives", """
WITH t AS (SELECT count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events),
top AS (SELECT array_to_string(list(user_id ORDER BY n DESC, user_id)[1:5], ',') AS best FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1))
SELECT 'adoption' AS highlight, purchases::VARCHAR AS detail FROM t WHERE purchases > errors UNION ALL SELECT 'reach', users::VARCHAR FROM t WHERE users >= 10 UNION ALL SELECT 'best', best FROM top""")
def positives(spark, sf):
    e = table(spark, sf, "events")
    t = e.agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    best = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "user_id"))), lambda x: x["user_id"].cast("string")), ",").alias("detail"))
    return t.where("purchases > errors").select(F.lit("adoption").alias("highlight"), F.col("purchases").cast("string").alias("detail")).unionByName(
        t.where("users >= 10").select(F.lit("reach").alias("highlight"), F.col("users").cast("string").alias("detail"))).unionByName(best.select(F.lit("best").alias("highlight"), "detail"))
