"""Text, colour and similarity queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import color, text
from sparkloom.functions.numbers import noisy_or, round_half_up
from sparkloom.operators import aggs, nearest, similarity
from sparkloom.plans.catalog import query
from sparkloom.plans.rollups import table
from sparkloom.scratch import spread

_WORDS = "list_filter(string_split(lower(text), ' '), lambda x: x <> '')"


def _words(c="text"):
    return F.filter(F.split(F.lower(c), " "), lambda x: x != "")


@query("shingles", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, greatest(len(w) - 2, 0)::INT AS n, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] || ' ' || w[3] END AS first FROM w""")
def shingles(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", text.shingles(_words()).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("fnv1a", """
SELECT n_nationkey, list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(n_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::UBIGINT)::BIGINT AS hash FROM nation""")
def fnv1a(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.fnv1a(F.col("n_name")).alias("hash"))


def _versions(spark, sf):
    """Token sequences: the quantities of each supplier's lines in order, and three later versions that lack the beginning."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("int").cast("string")).alias("all"))
    versions = li.select("l_suppkey", "all", F.explode(F.array(*map(F.lit, range(4)))).alias("v"))
    return versions.select(F.concat_ws("/", "l_suppkey", "v").alias("name"), F.slice("all", F.col("v") * 10 + 1, F.greatest(F.size("all") - F.col("v") * 10, F.lit(0))).alias("tokens"))


def _sketches(spark, sf):
    return _versions(spark, sf).select("name", text.minhash(F.col("tokens")).alias("sketch"))


@query("minhash_sketch")
def minhash_sketch(spark, sf):
    return _sketches(spark, sf).select("name", F.size("sketch").alias("lanes"), F.get("sketch", F.lit(0)).alias("lane0"), F.get("sketch", F.lit(63)).alias("lane63"))


@query("near_duplicates")
def near_duplicates(spark, sf):
    return similarity.candidate_pairs(_sketches(spark, sf), "name", 0.8)


@query("duplicate_clusters")
def duplicate_clusters(spark, sf):
    return similarity.clusters(_sketches(spark, sf), "name", 0.8)


@query("idf", f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM w)
SELECT word, count(*) AS df, floor(ln((SELECT n FROM n)::DOUBLE / count(*)) * 1000 + 0.5) / 1000 AS idf FROM w GROUP BY 1""")
def idf(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(_words()).alias("word"))
    return aggs.idf(w, "doc_id", "word")


@query("inverted_index", f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents)
SELECT word, count(*) AS n, md5(array_to_string(list(doc_id ORDER BY doc_id), ',')) AS ids FROM w GROUP BY 1""")
def inverted_index(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(_words())).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_id")), ",")).alias("ids"))


@query("set_similarity", """
WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a FROM orders GROUP BY 1), p AS (SELECT x.o_custkey, x.a, y.a AS b FROM s x JOIN s y ON y.o_custkey = x.o_custkey + 1)
SELECT o_custkey, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS jaccard,
 len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS overlap FROM p""")
def set_similarity(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    p = s.join(s.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("a").alias("b")), "o_custkey")
    return p.select("o_custkey", text.jaccard(F.col("a"), F.col("b")).alias("jaccard"), text.overlap(F.col("a"), F.col("b")).alias("overlap"))


_WEIGHTS = {"1-URGENT": 2.0, "2-HIGH": 1.5, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 0.05}
_W = "list_sum(list_transform({}, lambda x: CASE x WHEN '1-URGENT' THEN 2.0 WHEN '2-HIGH' THEN 1.5 WHEN '3-MEDIUM' THEN 1.0 ELSE 0.1 END))::DOUBLE"


@query("weighted_similarity", f"""
WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a FROM orders GROUP BY 1), p AS (SELECT x.o_custkey, x.a, y.a AS b FROM s x JOIN s y ON y.o_custkey = x.o_custkey + 1)
SELECT o_custkey, floor(CASE WHEN len(list_intersect(a, b)) < 2 THEN 0 ELSE {_W.format('list_intersect(a, b)')} / {_W.format('list_distinct(list_concat(a, b))')} END * 1000 + 0.5) / 1000 AS weighted_jaccard,
 floor(coalesce({_W.format('list_intersect(a, b)')}, 0) / {_W.format('b')} * 1000 + 0.5) / 1000 AS weighted_coverage FROM p""")
def weighted_similarity(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"))
    p = s.join(s.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("a").alias("b")), "o_custkey")
    w = F.create_map(*(F.lit(x) for kv in _WEIGHTS.items() for x in kv))
    return p.select("o_custkey", round_half_up(text.weighted_jaccard(F.col("a"), F.col("b"), w), 3).alias("weighted_jaccard"), round_half_up(text.weighted_coverage(F.col("a"), F.col("b"), w), 3).alias("weighted_coverage"))


@query("noisy_or", "SELECT l_orderkey, l_linenumber, l_suppkey, floor((1 - (1 - l_discount) * (1 - l_tax) * (1 - 0.5::DOUBLE * CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END)) * 1000 + 0.5) / 1000 AS score FROM lineitem")
def noisy_or_query(spark, sf):
    parts = F.array(F.col("l_discount"), F.col("l_tax"), 0.5 * F.when(F.col("l_returnflag") == "R", 1.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", noisy_or(parts).alias("score"))


@query("edit_distance", "SELECT n_nationkey, r_regionkey, levenshtein(n_name, r_name) AS dist FROM nation, region")
def edit_distance(spark, sf):
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.lit(True)).select("n_nationkey", "r_regionkey", F.levenshtein("n_name", "r_name").cast("long").alias("dist"))


@query("parse_dimension", """
WITH v AS (SELECT p_partkey, p_size, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 16.0::DOUBLE WHEN 2 THEN (p_size + 0.5::DOUBLE) * 16 WHEN 3 THEN NULL ELSE p_size::DOUBLE END AS px FROM v""")
def parse_dimension(spark, sf):
    size = F.col("p_size").cast("string")
    value = F.element_at(F.array(F.concat(size, F.lit("px")), F.concat(size, F.lit("rem")), F.concat(size, F.lit(".5em")), F.concat(size, F.lit("vh")), size), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.pixels(value).alias("px"))


_HEX = "lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0')"


def _colours(spark, sf):
    h = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0"))
    c = table(spark, sf, "part").select("p_partkey", h.alias("literal")).withColumn("hex", color.canonical_hex(F.col("literal")))
    return c.select("*", *(color.channel(F.col("hex"), i).alias(n) for i, n in enumerate("rgb")))


_LIN = "CASE WHEN {0} / 255 <= {1} THEN {0} / 255 / 12.92::DOUBLE ELSE pow(({0} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END"
_RGB = f"""c AS (SELECT p_partkey, {_HEX} AS h FROM part),
rgb AS (SELECT p_partkey, h || 'ff' AS hex, ('0x' || substr(h, 1, 2))::INT::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT::DOUBLE AS b FROM c)"""


@query("parse_color", f"WITH {_RGB} SELECT p_partkey, hex, r, g, b FROM rgb")
def parse_color(spark, sf):
    return _colours(spark, sf).select("p_partkey", "hex", "r", "g", "b")


@query("contrast_ratio", f"""
WITH {_RGB}, l AS (SELECT p_partkey, 0.2126::DOUBLE * ({_LIN.format('r', 0.03928)}) + 0.7152::DOUBLE * ({_LIN.format('g', 0.03928)}) + 0.0722::DOUBLE * ({_LIN.format('b', 0.03928)}) AS y FROM rgb),
k AS (SELECT p_partkey, 1.05::DOUBLE / (y + 0.05::DOUBLE) AS on_white FROM l)
SELECT p_partkey, printf('%.2f', floor(on_white * 100) / 100) || ':1' AS ratio, on_white >= 4.5 AS normal_text, on_white >= 3 AS large_text FROM k""")
def contrast_ratio(spark, sf):
    c = _colours(spark, sf).withColumn("on_white", color.contrast(F.lit(1.0), color.luminance(F.col("r"), F.col("g"), F.col("b"))))
    return c.select("p_partkey", color.format_ratio(F.col("on_white")).alias("ratio"), (F.col("on_white") >= color.NORMAL_TEXT).alias("normal_text"), (F.col("on_white") >= color.LARGE_TEXT).alias("large_text"))


def _lab_sql():
    lin = {c: _LIN.format(c, 0.04045) for c in "rgb"}
    lms = [f"cbrt({row[0]!r}::DOUBLE * ({lin['r']}) + {row[1]!r}::DOUBLE * ({lin['g']}) + {row[2]!r}::DOUBLE * ({lin['b']}))" for row in color.LMS]
    return [f"({row[0]!r}::DOUBLE * x + {row[1]!r}::DOUBLE * y + ({row[2]!r})::DOUBLE * z)" for row in color.LAB], lms


_LAB, _ROOTS = _lab_sql()


_TOKEN_RGB = """k AS (SELECT n_nationkey, lpad(lower(to_hex((n_nationkey * 654321 + 123) % 16777216)), 6, '0') AS h FROM nation),
trgb AS (SELECT n_nationkey AS p_partkey, ('0x' || substr(h, 1, 2))::INT::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT::DOUBLE AS b FROM k)"""


@query("nearest_color", f"""
WITH {_RGB}, {_TOKEN_RGB}, lms AS (SELECT p_partkey, {_ROOTS[0]} AS x, {_ROOTS[1]} AS y, {_ROOTS[2]} AS z FROM rgb), tlms AS (SELECT p_partkey, {_ROOTS[0]} AS x, {_ROOTS[1]} AS y, {_ROOTS[2]} AS z FROM trgb),
lab AS (SELECT p_partkey, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM lms), tlab AS (SELECT p_partkey, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM tlms),
d AS (SELECT x.p_partkey, k.p_partkey AS token, floor(sqrt((x.l - k.l) * (x.l - k.l) + (x.a - k.a) * (x.a - k.a) + (x.b - k.b) * (x.b - k.b)) * 100000 + 0.5) / 100000 AS dist FROM lab x, tlab k),
n AS (SELECT p_partkey, arg_min(token, (dist, token)) AS token, min(dist) AS dist FROM d GROUP BY 1)
SELECT p_partkey, token, floor(dist * 1000 + 0.5) / 1000 AS distance, CASE WHEN dist = 0 THEN 'exact' WHEN dist < 0.02 THEN 'near' WHEN dist < 0.1 THEN 'shade' ELSE 'foreign' END AS class FROM n""")
def nearest_color(spark, sf):
    """Colours of the parts against a palette of a colour a nation."""
    from sparkloom.operators.joins import nearest

    lab = _colours(spark, sf).select("p_partkey", *(x.alias(n) for x, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), "LAB", strict=True)))
    own = F.lpad(F.lower(F.hex((F.col("n_nationkey").cast("long") * 654321 + 123) % 16777216)), 6, "0")
    palette = table(spark, sf, "nation").select(F.col("n_nationkey").alias("token"), color.canonical_hex(F.concat(F.lit("#"), own)).alias("hex"))
    tokens = palette.select("token", *(x.alias(f"k{n}") for x, n in zip(color.oklab(*(color.channel(F.col("hex"), i) for i in range(3))), "LAB", strict=True)))
    found = nearest(spread(lab, "p_partkey"), tokens, color.distance([F.col(n) for n in "LAB"], [F.col(f"k{n}") for n in "LAB"]), ["p_partkey"], ["token"], ["token"])
    kind = F.when(F.col("distance") == 0, "exact").when(F.col("distance") < color.NEAR, "near").when(F.col("distance") < color.SHADE, "shade").otherwise("foreign")
    return found.select("p_partkey", "token", round_half_up(F.col("distance"), 3).alias("distance"), kind.alias("class"))


_SUPPLIED = """trgb AS (SELECT s_suppkey AS p_partkey, ('0x' || substr(h, 1, 2))::INT::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT::DOUBLE AS b
FROM (SELECT s_suppkey, lpad(lower(to_hex((s_suppkey * 654321 + 123) % 16777216)), 6, '0') AS h FROM supplier))"""


@query("nearest_color_grid", f"""
WITH {_RGB}, {_SUPPLIED}, lms AS (SELECT p_partkey, {_ROOTS[0]} AS x, {_ROOTS[1]} AS y, {_ROOTS[2]} AS z FROM rgb), tlms AS (SELECT p_partkey, {_ROOTS[0]} AS x, {_ROOTS[1]} AS y, {_ROOTS[2]} AS z FROM trgb),
lab AS (SELECT p_partkey, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM lms), tlab AS (SELECT p_partkey, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM tlms),
d AS (SELECT x.p_partkey, k.p_partkey AS token, floor(sqrt((x.l - k.l) * (x.l - k.l) + (x.a - k.a) * (x.a - k.a) + (x.b - k.b) * (x.b - k.b)) * 100000 + 0.5) / 100000 AS dist FROM lab x, tlab k)
SELECT p_partkey, arg_min(token, (dist, token)) AS token, floor(min(dist) * 1000 + 0.5) / 1000 AS distance FROM d GROUP BY 1""")
def nearest_color_grid(spark, sf):
    """Colours of the parts against a palette that grows with the tables: a colour a supplier, by a grid with rings."""
    lab = _colours(spark, sf).select("p_partkey", *(x.alias(n) for x, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), "LAB", strict=True)))
    own = F.lpad(F.lower(F.hex((F.col("s_suppkey").cast("long") * 654321 + 123) % 16777216)), 6, "0")
    palette = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("token"), color.canonical_hex(F.concat(F.lit("#"), own)).alias("hex"))
    tokens = palette.select("token", *(x.alias(f"k{n}") for x, n in zip(color.oklab(*(color.channel(F.col("hex"), i) for i in range(3))), "LAB", strict=True)))
    point, other = [F.col(n) for n in "LAB"], [F.col(f"k{n}") for n in "LAB"]
    found = nearest.nearest_point(lab, tokens, point, other, color.distance(point, other), ["p_partkey"], ["token"], ["token"], color.SHADE)
    return found.select("p_partkey", "token", round_half_up(F.col("distance"), 3).alias("distance"))


@query("oklch", f"""
WITH {_RGB}, lms AS (SELECT p_partkey, {_ROOTS[0]} AS x, {_ROOTS[1]} AS y, {_ROOTS[2]} AS z FROM rgb), lab AS (SELECT p_partkey, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM lms),
h AS (SELECT *, sqrt(a * a + b * b) AS c, degrees(atan2(b, a)) AS d FROM lab)
SELECT p_partkey, floor(floor(l * 100000 + 0.5) / 100000 * 1000 + 0.5) / 1000 AS lightness, floor(floor(c * 100000 + 0.5) / 100000 * 1000 + 0.5) / 1000 AS chroma,
       floor(floor((CASE WHEN d < 0 THEN d + 360 ELSE d END) * 1000 + 0.5) / 1000 * 10 + 0.5) / 10 AS hue FROM h""")
def oklch(spark, sf):
    c = _colours(spark, sf)
    found = c.select("p_partkey", *(x.alias(n) for x, n in zip(color.oklch(F.col("r"), F.col("g"), F.col("b")), ("lightness", "chroma", "hue"), strict=True)))
    return found.select("p_partkey", round_half_up(F.col("lightness"), 3).alias("lightness"), round_half_up(F.col("chroma"), 3).alias("chroma"), round_half_up(F.col("hue"), 1).alias("hue"))


@query("css_names", r"""
SELECT p_partkey, lower(regexp_replace(key, '([A-Z])', '-\1', 'g')) AS property FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'backgroundColor' WHEN 1 THEN 'borderTopWidth' ELSE 'color' END AS key FROM part)""")
def css_names(spark, sf):
    k = F.element_at(F.array(F.lit("backgroundColor"), F.lit("borderTopWidth"), F.lit("color")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.css_property(k).alias("property"))


@query("html_elements", r"SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2")
def html_elements(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("link_targets", r"""
SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1""")
def link_targets(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return t.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("missing_attribute", r"""
SELECT page_id, len(list_filter(tags, lambda t: NOT contains(t, 'class=')))::INT AS plain, len(tags)::INT AS every FROM (SELECT page_id, regexp_extract_all(html, '<div[^>]*>') AS tags FROM pages)""")
def missing_attribute(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<div[^>]*>"), F.lit(0)).alias("tags"))
    return t.select("page_id", F.size(F.filter("tags", lambda x: ~x.contains("class="))).alias("plain"), F.size("tags").alias("every"))


@query("json_prop", "SELECT event_id, len(json_keys(props))::INT AS n, md5(array_to_string(list_sort(json_keys(props)), ',')) AS keys FROM events")
def json_prop(spark, sf):
    k = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.size(k).alias("n"), F.md5(F.array_join(F.array_sort(k), ",")).alias("keys"))


@query("plural_forms", """
SELECT p_partkey, p_size || ' ' || CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'one' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS label FROM part""")
def plural_forms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.col("p_size").cast("string"), text.russian_plural(F.col("p_size"), "one", "few", "many")).alias("label"))


@query("source_lines", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::INT AS longest FROM documents")
def source_lines(spark, sf):
    lines = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("lines"), F.array_max(F.transform(lines, F.length)).alias("longest"))


@query("overrides_codec", """
SELECT o_orderkey, 'p:' || o_orderpriority || ';s:' || o_orderstatus AS packed, o_orderstatus AS status FROM orders""")
def overrides_codec(spark, sf):
    packed = F.concat(F.lit("p:"), F.col("o_orderpriority"), F.lit(";s:"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", packed.alias("packed")).withColumn("status", F.str_to_map("packed", F.lit(";"), F.lit(":"))["s"])


@query("glob_match", "SELECT page_id, regexp_matches(url, '^http.*en.*$') AS matched FROM pages")
def glob_match(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(text.glob_pattern("http*en*")).alias("matched"))
