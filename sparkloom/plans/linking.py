"""Joins and graph queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import graph, joins, nearest
from sparkloom.plans.catalog import query
from sparkloom.plans.rollups import table


@query("owning_asof", """
WITH s AS (SELECT user_id, ts, min(event_id) AS owner FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT e.event_id, s.owner FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def owning_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.asof_backward(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type"), "user_id", "ts", {"event_id": "owner"}, "event_id").select("event_id", "owner")


@query("band_join", """
SELECT d.event_id, array_to_string(list_sort(list(DISTINCT e.event_type)), ',') AS later, count(*) AS n FROM events d JOIN events e ON d.user_id = e.user_id AND e.ts >= d.ts
WHERE d.event_type = 'signup' GROUP BY 1""")
def band_join(spark, sf):
    # open-ended range in one key: a running frame over the sorted key instead of a range join
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc()).rangeBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.collect_set("event_type").over(w).alias("later"), F.count("*").over(w).alias("n"))
    return e.where("event_type = 'signup'").select("event_id", F.array_join(F.array_sort("later"), ",").alias("later"), "n")


@query("first_match_join", """
WITH b AS (SELECT l_partkey, l_suppkey AS supplier, l_orderkey AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1)
SELECT p_partkey, supplier, first_order FROM part LEFT JOIN b ON p_partkey = l_partkey""")
def first_match_join(spark, sf):
    build = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("first_order"))
    return joins.first_match_join(table(spark, sf, "part").select("p_partkey"), build, ["p_partkey"], ["l_orderkey", "l_linenumber"], ["supplier", "first_order"])


@query("priority_link", """
WITH k AS (SELECT event_id, unnest([event_type || '-' || (user_id % 3), event_type, 'any']) AS key, unnest([0, 1, 2]) AS pos FROM events),
d AS (SELECT unnest(['error-0', 'view', 'error', 'purchase-1']) AS key, unnest(['hot', 'page', 'bad', 'sale']) AS target)
SELECT e.event_id, coalesce(m.target, 'unused') AS target FROM events e LEFT JOIN (SELECT event_id, arg_min(target, pos) AS target FROM k JOIN d USING (key) GROUP BY 1) m USING (event_id)""")
def priority_link(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    keys = e.select("event_id", F.posexplode(F.array(F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")), F.col("event_type"), F.lit("any"))).alias("pos", "key"))
    d = spark.createDataFrame([("error-0", "hot"), ("view", "page"), ("error", "bad"), ("purchase-1", "sale")], "key string, target string")
    best = keys.join(F.broadcast(d), "key").groupBy("event_id").agg(F.min_by("target", "pos").alias("target"))
    return e.join(best, "event_id", "left").select("event_id", F.coalesce("target", F.lit("unused")).alias("target"))


RULES = [("example.com", "own"), ("com", "commercial"), ("example.net", "network"), ("org", "charity")]


@query("longest_prefix", """
WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'own' WHEN host LIKE '%.com' THEN 'commercial' WHEN host LIKE '%.example.net' THEN 'network' WHEN host LIKE '%.org' THEN 'charity' ELSE 'default' END AS level FROM h""")
def longest_prefix(spark, sf):
    turned = lambda c: F.array_join(F.reverse(F.split(c, r"\.")), ".")
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host")).withColumn("key", turned(F.col("host")))
    rules = spark.createDataFrame(RULES, "suffix string, level string").withColumn("rule", turned(F.col("suffix")))
    return joins.longest_prefix_join(rows, "key", rules, "rule", "level").select("page_id", "host", F.coalesce("level", F.lit("default")).alias("level"))


@query("neighbours_on_scale", """
WITH s AS (SELECT unnest([2, 4, 8, 12, 16, 24, 32, 48]) AS v)
SELECT p_partkey, p_size, list_contains([2, 4, 8, 12, 16, 24, 32, 48], p_size) AS on_scale, (SELECT max(v) FROM s WHERE v < p_size) AS below, (SELECT min(v) FROM s WHERE v > p_size) AS above FROM part""")
def neighbours_on_scale(spark, sf):
    scale = F.array(*(F.lit(v) for v in (2, 4, 8, 12, 16, 24, 32, 48)))
    return table(spark, sf, "part").select(
        "p_partkey", "p_size", F.array_contains(scale, F.col("p_size")).alias("on_scale"),
        F.array_max(F.filter(scale, lambda v: v < F.col("p_size"))).alias("below"), F.array_min(F.filter(scale, lambda v: v > F.col("p_size"))).alias("above"))


WORDS = ["PROMO", "ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD", "BRUSHED", "STEEL", "BRASS", "COPPER", "TIN", "NICKEL"]


@query("nearest_string", f"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part), d AS (SELECT unnest({WORDS}) AS entry),
x AS (SELECT word, entry, levenshtein(upper(word), entry) AS dist, greatest(1, least(2, length(word) // 3)) AS most FROM w, d),
b AS (SELECT word, min(dist) AS dist FROM x WHERE dist <= most GROUP BY word)
SELECT x.word, min(entry) AS suggestion FROM x JOIN b ON x.word = b.word AND x.dist = b.dist GROUP BY x.word HAVING count(*) = 1""")
def nearest_string(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word")).distinct()
    upper = words.select("word", F.upper("word").alias("_up"))
    found = nearest.suggestions(upper, "_up", spark.createDataFrame([(w,) for w in WORDS], "entry string"), "entry")
    return upper.join(found.withColumnRenamed("word", "_up"), "_up").select("word", "suggestion")


@query("nearest_vector", """
WITH c AS (SELECT vec_id AS cid, embedding AS ce FROM embeddings WHERE vec_id < 8),
x AS (SELECT vec_id, cid, floor(sqrt(list_sum(list_transform(list_zip(embedding, ce), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) * 100000 + 0.5) / 100000 AS dist FROM embeddings, c)
SELECT vec_id, arg_min(cid, (dist, cid)) AS nearest, min(dist) AS distance FROM x GROUP BY vec_id""")
def nearest_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    c = e.where("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("ce"))
    square = F.aggregate(F.zip_with("embedding", "ce", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return joins.nearest(e.select("vec_id", "embedding"), c, F.floor(F.sqrt(square) * 100000 + 0.5) / 100000, ["vec_id"], ["cid"], ["cid"]).select("vec_id", F.col("cid").alias("nearest"), "distance")


@query("dangling_references", """
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber - 1 AND b.l_quantity > 10)
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')""")
def dangling_references(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    declared = li.where("l_quantity > 10").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"))
    escape = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return li.where("l_linenumber > 1").join(declared, ["l_orderkey", "l_linenumber"], "left_anti").join(escape, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("missing_names", """
SELECT o_orderkey, CASE WHEN l.k IS NOT NULL THEN 'named' WHEN o_orderstatus = 'P' THEN 'undecidable' ELSE 'unnamed' END AS verdict FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON l.k = o_orderkey""")
def missing_names(spark, sf):
    labelled = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("labelled")).distinct()
    return table(spark, sf, "orders").join(labelled, "o_orderkey", "left").select(
        "o_orderkey", F.when(F.col("labelled"), "named").when(F.col("o_orderstatus") == "P", "undecidable").otherwise("unnamed").alias("verdict"))


@query("block_pivot", """
SELECT l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) FILTER (WHERE l_returnflag = 'N') AS colour, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) FILTER (WHERE l_returnflag = 'A') AS background FROM lineitem GROUP BY 1""")
def block_pivot(spark, sf):
    last = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "l_extendedprice")))["l_extendedprice"]
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(last("N").alias("colour"), last("A").alias("background"))


@query("canonical_component", "SELECT p_brand, arg_min(p_name, (length(p_name), p_name)) AS component FROM part GROUP BY 1")
def canonical_component(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min(F.struct(F.length("p_name").alias("n"), "p_name")).alias("b")).select("p_brand", F.col("b.p_name").alias("component"))


@query("module_resolve", """
WITH c AS (SELECT page_id, unnest([regexp_replace(url, '[?#].*$', ''), regexp_replace(url, '[?#].*$', '') || '/', regexp_replace(url, '[?#].*$', '') || '.html']) AS candidate, unnest([0, 1, 2]) AS pos FROM pages)
SELECT page_id, arg_min(candidate, pos) AS target FROM c WHERE candidate IN (SELECT url FROM pages) GROUP BY 1""")
def module_resolve(spark, sf):
    plain = F.regexp_replace("url", "[?#].*$", "")
    p = table(spark, sf, "pages")
    c = p.select("page_id", F.posexplode(F.array(plain, F.concat(plain, F.lit("/")), F.concat(plain, F.lit(".html")))).alias("pos", "candidate"))
    return c.join(p.select(F.col("url").alias("candidate")), "candidate", "left_semi").groupBy("page_id").agg(F.min_by("candidate", "pos").alias("target"))


@query("dedup_keep_first", "SELECT user_id, min(event_id) AS event_id FROM events e WHERE ts = (SELECT min(ts) FROM events f WHERE f.user_id = e.user_id) GROUP BY 1")
def dedup_keep_first(spark, sf):
    return joins.first_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id"])


@query("span_containment", """
WITH s AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS a, max(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS z FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_linenumber BETWEEN s.a AND s.z WHERE l.l_returnflag <> 'R'""")
def span_containment(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    line = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    spans = li.groupBy("l_orderkey").agg(F.min(line).alias("a"), F.max(line).alias("z")).where("a is not null")
    return li.where("l_returnflag <> 'R'").join(spans, "l_orderkey").where("l_linenumber BETWEEN a AND z").select("l_orderkey", "l_linenumber")


@query("registry_replacement", "SELECT c_nationkey AS id, 'generic' AS origin FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) GROUP BY 1 UNION ALL SELECT s_nationkey, 'adapter' FROM supplier WHERE s_acctbal > 8000 GROUP BY 1")
def registry_replacement(spark, sf):
    adapter = table(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("id")).distinct()
    generic = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id")).distinct().join(adapter, "id", "left_anti")
    return generic.withColumn("origin", F.lit("generic")).unionByName(adapter.withColumn("origin", F.lit("adapter")))


@query("distinct_union", """
SELECT key, arg_min(source, rank) AS source FROM (SELECT c_nationkey AS key, 'customer' AS source, 0 AS rank FROM customer UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier UNION ALL SELECT n_nationkey, 'nation', 2 FROM nation) GROUP BY 1""")
def distinct_union(spark, sf):
    parts = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")]
    rows = None
    for rank, (name, column) in enumerate(parts):
        one = table(spark, sf, name).select(F.col(column).alias("key"), F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.min_by("source", "rank").alias("source"))


@query("array_set_operations", """
WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS a, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders GROUP BY 1),
c AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT o_custkey, len(list_intersect(a, b))::INT AS shared, len(list_distinct(list_concat(a, b)))::INT AS every, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS missing FROM c""")
def array_set_operations(spark, sf):
    side = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(side("O").alias("a"), side("F").alias("b")).select(
        "o_custkey", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("every"), F.size(F.array_except("a", "b")).alias("missing"))


@query("closure", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
w AS (SELECT 'r' || r_regionkey AS node, r_name AS origin, 0 AS depth FROM region UNION SELECT e.b, w.origin, w.depth + 1 FROM w JOIN e ON w.node = e.a)
SELECT origin, depth, count(*) AS n FROM w GROUP BY 1, 2""")
def closure(spark, sf):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")).unionByName(
        table(spark, sf, "customer").select(key("n", "c_nationkey").alias("a"), key("c", "c_custkey").alias("b"))).unionByName(
        table(spark, sf, "supplier").select(key("n", "s_nationkey").alias("a"), key("s", "s_suppkey").alias("b")))
    seeds = table(spark, sf, "region").select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("origin"))
    return graph.closure(seeds, edges).groupBy("origin", "depth").agg(F.count("*").alias("n"))


@query("chain_resolve", """
WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 11 = 7 THEN p_partkey + 1 WHEN p_partkey % 11 = 8 THEN p_partkey - 1 ELSE p_partkey // 2 END AS next FROM part),
w AS (SELECT node AS start, node AS here, [node] AS path, false AS loops FROM n UNION ALL
 SELECT w.start, n.next, list_append(w.path, n.next), list_contains(w.path, n.next) FROM w JOIN n ON w.here = n.node WHERE n.next IS NOT NULL AND NOT w.loops AND len(w.path) <= 9),
l AS (SELECT start, arg_max({'a': here, 'l': loops, 'p': path}, len(path)) AS x FROM w GROUP BY start)
SELECT start, CASE WHEN x.l OR len(x.p) > 9 THEN NULL ELSE x.a END AS "end" FROM l""")
def chain_resolve(spark, sf):
    nodes = table(spark, sf, "part").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 11 = 7 THEN p_partkey + 1 WHEN p_partkey % 11 = 8 THEN p_partkey - 1 ELSE p_partkey div 2 END AS next")
    return graph.chain_end(nodes.select("node"), nodes.where("next is not null")).select("start", "end")


@query("connected_components", """
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey % 10 AS b FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT c_custkey - c_custkey % 10, c_custkey FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON w.node = e.a)
SELECT node, min(root) AS component FROM w GROUP BY 1""")
def connected_components(spark, sf):
    e = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - F.col("c_custkey") % 10).alias("b"))
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = graph.components(e, "a", "b")
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


@query("package_name", """
WITH s AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS spec FROM pages)
SELECT page_id, string_split(spec, '/')[1] AS package, length(spec) > length(string_split(spec, '/')[1]) AS deep FROM s""")
def package_name(spark, sf):
    spec = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf, "pages").select("page_id", text.package_name(spec).alias("package"), text.is_deep(spec).alias("deep"))


@query("adapter_select", """
WITH c AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS declared FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT event_type, n, declared FROM c ORDER BY n DESC, declared DESC, event_type LIMIT 1""")
def adapter_select(spark, sf):
    c = table(spark, sf, "events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("declared"))
    return c.orderBy(F.desc("n"), F.desc("declared"), "event_type").limit(1)


@query("unknown_rule_ids", """
WITH k AS (SELECT unnest(['growth', 'event.err', 'event', 'usage.view', 'event.view']) AS key), r AS (SELECT DISTINCT 'event.' || event_type AS rule FROM events)
SELECT key FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rule = k.key OR starts_with(r.rule, k.key || '.'))""")
def unknown_rule_ids(spark, sf):
    rules = table(spark, sf, "events").select(F.concat(F.lit("event."), F.col("event_type")).alias("rule")).distinct()
    prefixes = rules.select(F.explode(joins.dotted_prefixes(F.col("rule"))).alias("key")).distinct()
    keys = spark.createDataFrame([(k,) for k in ("growth", "event.err", "event", "usage.view", "event.view")], "key string")
    return keys.join(prefixes, "key", "left_anti")
