import json

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import edits
from sparkloom.operators import dictionary, limits
from sparkloom.plans import rules
from sparkloom.sources import settings
from tests.test_rules import elements, styles

RE_EXPORTS = "file string, specifier string, target string, name string, as string, star boolean"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_module_exports(spark):
    local = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "default"), ("c", "A"), ("d", "D")], "file string, name string")
    edges = spark.createDataFrame(
        [("i", "./a", "a", None, None, True), ("i", "./b", "b", None, None, True), ("b", "./c", "c", None, None, True), ("c", "./b", "b", None, None, True), ("i", "./d", "d", "D", "Dee", False), ("i", "lib/x", None, None, None, True), ("b", "lib", None, None, None, True)], RE_EXPORTS)
    got = rows(dictionary.module_exports(local, edges), "file", "name", "rank")
    assert [g for g in got if g[0] == "i"] == [("i", "A", 0), ("i", "B", 0), ("i", "Dee", 1)]
    assert ("b", "A", 0) in got and ("c", "B", 0) in got and ("c", "A", 2) in got and ("c", "default", 0) not in got
    assert rows(dictionary.external_re_exports(edges), "package", "origins") == [("lib", ["b", "i"])]


def test_dependencies_owners_assets(spark):
    imports = spark.createDataFrame([("x/a.ts", "@k/ui/deep", None), ("x/a.ts", "./b", "x/b.ts"), ("x/b.ts", "react", None), ("y/c.ts", "@k/ui", None), ("x/b.ts", "./a", "x/a.ts")], "file string, specifier string, target string")
    assert rows(dictionary.external_dependencies(imports), "directory", "package") == [("x", "@k/ui"), ("x", "react"), ("y", "@k/ui")]
    assert rows(dictionary.external_dependencies(imports, "@k/"), "directory", "package") == [("x", "@k/ui"), ("y", "@k/ui")]
    assert rows(dictionary.external_imports(imports, spark.createDataFrame([("x/a.ts",)], "file string")), "package") == [("@k/ui",), ("react",)]
    directories = spark.createDataFrame([("x",), ("y",)], "directory string")
    assert rows(dictionary.public_directories(directories, imports.select("target")), "directory", "public") == [("x", True), ("y", False)]
    first, second = (spark.createDataFrame(x, "name string, origin string") for x in ([("A", "x/a.ts")], [("A", "z"), ("B", "x/b.ts")]))
    owners = spark.createDataFrame([("x/a.ts", "Alpha")], "file string, owner string")
    assert rows(dictionary.public_symbols([first, second], owners), "name", "origin", "owner") == [("A", "x/a.ts", "Alpha"), ("B", "x/b.ts", None)]
    files = spark.createDataFrame([("b/b.stories.tsx",), ("b/README.md",), ("b/x.test.ts",), ("b/x.ts",), ("top.md",), ("b/package.json",), ("b/src/index.ts",), ("c/package.json",), ("old/package.json",)], "file string")
    assert rows(dictionary.assets(files), "directory", "kind", "files") == [("b", "docs", ["b/README.md"]), ("b", "stories", ["b/b.stories.tsx"]), ("b", "tests", ["b/x.test.ts"])]
    assert rows(dictionary.discover(files, ["ol?"]), "directory", "entry") == [("b", "b/src/index.ts"), ("c", None)]


def test_variants_counts_icons_themes(spark):
    groups = spark.createDataFrame([("f", "Button", "size", ["l", "s"]), ("g", "Button", "size", ["m", "s"])], "file string, name string, prop string, values array<string>")
    assert rows(dictionary.recipe_variants(groups), "name", "prop", "values") == [("Button", "size", ["l", "m", "s"])]
    parts = spark.createDataFrame([(["a", "b"], {"size": ["s", "m"], "kind": ["x"]}, None), (None, None, ["r"])], "props array<string>, variants map<string,array<string>>, slots array<string>")
    assert tuple(dictionary.nested_counts(parts).first()) == (2, 2, 1, 2, 3)
    svg = '<svg><circle cx="1" r="2"/></svg>'
    found, bad = dictionary.icons(spark.createDataFrame([("i/home-24.svg", svg), ("i/16/home.svg", svg), ("i/none.svg", "<svg/>")], "file string, content string"))
    assert rows(found, "name", "size") == [("home", 16), ("home", 24)] and bad.first()[0] == 1
    variables = spark.createDataFrame(
        [("--a", "light", "var(--b)"), ("--b", "light", "1px solid var(--c)"), ("--c", "light", "#fff"), ("--c", "dark", "#000"), ("--x", "light", "var(--x)"), ("--y", "light", "var(--none) 2px")], "name string, mode string, value string")
    got = {(r.name, r.mode): r.value for r in dictionary.theme_values(variables).collect()}
    assert got["--a", "light"] == "1px solid #fff" and got["--a", "dark"] == "1px solid #000" and got["--x", "light"] == "var(--x)" and got["--y", "dark"] == "var(--none) 2px"
    kinds = spark.createDataFrame([("sys.fontSize.m", "14px"), ("ref.radius", "4px"), ("ref.red", "#F00"), ("z", "solid"), ("k", "3")], "p string, v string").select(dictionary.token_kind(F.col("p"), F.col("v")))
    assert [r[0] for r in kinds.collect()] == ["fontSize", "dimension", "color", "other", "number"]
    assert spark.createDataFrame([("{ref.red} and {a-b.c}",)], "v string").select(dictionary.references(F.col("v"))).first()[0] == ["ref.red", "a-b.c"]


def test_edits(spark):
    line = "  <input tabIndex={3} autoFocus name='a' />;"
    df = spark.createDataFrame([(line,)], "line string")
    one = lambda *c: tuple(df.select(*c).first())
    lit = F.lit
    assert one(edits.deletion_of(F.col("line"), lit("autoFocus")), edits.deletion_of(F.col("line"), lit("nope")), edits.deletion_of(lit("autoFocus x"), lit("autoFocus"))) == (" autoFocus", None, "autoFocus")
    fix = lambda rule, at: edits.lint_fix(lit(rule), F.col("line"), lit(at))
    a, b, c, d = one(fix("tabindex-no-positive", line.index("tabIndex") + 1), fix("no-autofocus", line.index("autoFocus") + 1), fix("no-autofocus", 2), fix("tabindex-no-positive", 999))
    assert tuple(a) == ("tabIndex={3}", "tabIndex={0}") and tuple(b) == (" autoFocus", "") and c is None and d is None
    assert one(edits.patched(F.col("line"), lit(" autoFocus"), lit("")), edits.patched(F.col("line"), lit("name"), lit("done()"), True), edits.patched(F.col("line"), lit("zzz"), lit("")), edits.occurs_on(F.col("line"), lit("name"))) == (
        "  <input tabIndex={3} name='a' />;", "  done();", None, True)
    assert one(edits.literal_column(lit(3), lit("css"), lit("color"), lit(4)), edits.literal_column(lit(3), lit("jss"), lit("color"), lit(4))) == (14, 7)


def test_limitations_and_orders(spark):
    v = styles(spark, ("d", 1, "outline", "none", "jss", "x", False), ("e", 1, "outline", "none", "css", "x", False), ("f", 1, "outline", "none", "jss", "a:focus", False))
    e = elements(spark, ("a", 4, "div", None, {"role": "menu"}, {}, [], None), ("a", 5, "M", "Menu", {"role": "menu"}, {}, [], None))
    every = limits.all_limitations(limits.focus_limitations(v, rules.FLATTENED), limits.keyboard_limitations(e, ["menu"], None), spark.createDataFrame([("a", None, "file-too-large", "9")], schemas.LIMITATIONS))
    assert [(r.file, r.line, r.reason) for r in every.collect()] == [("a", None, "file-too-large"), ("a", 4, "spec-unavailable"), ("d", 1, "unsupported-syntax")]
    assert limits.not_checked(every).count() == 2 and limits.keyboard_limitations(e, ["menu"], e).count() == 0
    f = spark.createDataFrame([("r1", "info", 9, "a", 1, 0), ("r2", "error", 1, "b", 1, 1), ("r3", "error", 5, "a", 2, 2)], "id string, severity string, occurrences int, file string, line int, ord int")
    assert [r.id for r in limits.flat_order(f).collect()] == ["r3", "r2", "r1"]
    assert rows(limits.new_only(f, f.where("id = 'r2'"), ["id"]), "id") == [("r1",), ("r3",)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(limits.replace_rules(ids("a", "b"), ids("c"), ids("b")), "id") == [("a",), ("c",)]


def test_settings(spark, tmp_path):
    maps = spark.createDataFrame([({"a": "off", "b": "on"}, {"b": "error", "c": "info"}, "x:off;y:bad;;z:error")], "m map<string,string>, n map<string,string>, s string")
    got = maps.select(settings.merged(F.col("m"), F.col("n")).alias("m"), settings.parse_overrides(F.col("s")).alias("s"), settings.pack_overrides(settings.merged(F.col("m"), F.col("n"))).alias("p")).first()
    assert got.m == {"a": "off", "b": "error", "c": "info"} and got.s == {"x": "off", "z": "error"} and got.p == "a:off;b:error;c:info"
    (tmp_path / settings.FILE).write_text('{"rules": {"a": "off", "b": "inherit"}}')
    assert settings.load_settings(here=str(tmp_path)) == ({"a": "off"}, str(tmp_path / settings.FILE)) and settings.load_settings(here=str(tmp_path / "none")) == ({}, None)
    with pytest.raises(FileNotFoundError):
        settings.load_settings("no.json", here=str(tmp_path))
    for bad in ('{"rule": {}}', '{"rules": {"a": "loud"}}', '{"rules": {"a": 2}}'):
        with pytest.raises(ValueError):
            settings.parse_settings(bad)
    rules.applicable(rules.Tables())
    rows_ = settings.catalog_rows(spark, rules.REGISTRY).orderBy("ord").collect()
    assert len(rows_) == 32 and rows_[0].category == "a11y" and rows_[-1].category == "override"
    assert settings.parse_settings(settings.settings_template(rules.REGISTRY)) == {} and json.loads(settings.settings_schema(rules.REGISTRY))["additionalProperties"] is False
    assert settings.stable_json({"b": {"d": 1, "c": 2}, "a": []}) == '{\n  "a": [],\n  "b": {\n    "c": 2,\n    "d": 1\n  }\n}\n'
    page = settings.page("A<b", '{"x": "</script>\u2028"}')
    assert page.count("</script>") == 1 and "\\u003c/script>\\u2028" in page and "A&lt;b" in page
    found = rules.run_rules(rules.Tables(style_values=styles(spark, ("a", 1, "font-family", "Arial", "css", "p", False))), ["font"])
    documents = {r.kind: json.loads(r.document) for r in settings.payload(found).collect()}
    assert documents["finding"]["expected"] == "" and documents["categories"] == dict.fromkeys(settings.CATEGORIES, 0) | {"font": 1}


def test_adapters(spark):
    a, b, c = (settings.Adapter(n, p, lambda s: {}, rules=["x.own"], replaces=["component.duplicate"]) for n, p in (("one", ["@k/ui"]), ("two", ["@m/ui", "@m/icons"]), ("three", ["z"])))
    used = spark.createDataFrame([("@m/ui",), ("@k/ui",), ("@k/ui",), (None,)], "package string")
    assert settings.select_adapter([a, b, c], {"@k/ui", "@m/ui"}, used).id == "one" and settings.select_adapter([a, b, c], {"z"}, used).id == "three"
    assert settings.select_adapter([a, b], {"@k/ui", "@m/ui", "@m/icons"}, used.limit(0)).id == "two" and settings.select_adapter([a], set(), used) is None
    assert "component.duplicate" not in settings.active_rules(rules.REGISTRY, a) and "x.own" in settings.active_rules(rules.REGISTRY, a)
