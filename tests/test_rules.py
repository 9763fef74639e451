from sparkloom import schemas
from sparkloom.plans import rules, rules_kit
from sparkloom.sources import configs, files, sinks, stylesheet


def styles(spark, *rows):
    full = [(f, line, 1, i, p, v, v, src, sel, [], False, False, ("kit", "Button", None) if kit else None) for i, (f, line, p, v, src, sel, kit) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.STYLE_VALUES)


def elements(spark, *rows):
    return spark.createDataFrame([(f, line, 1, i, n, None, k, p, e, [], keys, t, False) for i, (f, line, n, k, p, e, keys, t) in enumerate(rows)], schemas.ELEMENTS)


def test_focus_and_contrast(spark):
    v = styles(
        spark, ("a.css", 1, "outline", "none", "css", "a:focus", False), ("a.css", 3, "outline", "none", "css", "b:focus", False), ("a.css", 4, "box-shadow", "0 0 1px", "css", "b:focus", False),
        ("b.css", 1, "outline", "0", "css", "*", False), ("c.css", 1, "color", "#888", "css", "p", False), ("c.css", 2, "background", "#fff", "css", "p", False), ("c.css", 5, "color", "#000", "css", "q", False))
    t = rules.Tables(style_values=v)
    assert sorted((r.file, r.subkind) for r in rules.focus_suppressed(t).collect()) == [("a.css", "onFocus"), ("b.css", "blanket")]
    found = rules.contrast_text(t).collect()
    assert [(r.file, r.severity, r.actual, r.impactKey) for r in found] == [("c.css", "warning", "3.54:1", "a11y.contrast.text:#888:#fff")]


def test_aria_names_relations_focus(spark):
    e = elements(
        spark, ("a", 2, "div", None, {"role": "slider"}, {}, [], "x"), ("a", 3, "nav", None, {"role": "navigation"}, {}, [], "x"), ("a", 4, "div", None, {"role": "buton"}, {}, [], "x"),
        ("a", 5, "button", None, {}, {}, [], " "), ("a", 6, "button", None, {"id": "q"}, {}, [], None), ("a", 7, "label", None, {"htmlFor": "q"}, {}, [], "Q"),
        ("a", 8, "div", None, {"aria-labelledby": "q gone"}, {}, [], None), ("b", 9, "div", None, {"role": "dialog"}, {}, [], None), ("b", 30, "div", None, {"role": "dialog"}, {}, [], None), ("b", 31, "div", None, {}, {}, ["Escape"], None))
    d = spark.createDataFrame([("b", 1, 1, 0, "One", "component", [], [], [], [], [], 1, 0, [], []), ("b", 20, 1, 1, "Two", "component", [], [], [], [], [], 1, 0, [], [])], schemas.DECLARATIONS)
    t = rules.Tables(elements=e, declarations=d)
    assert [r.impactKey for r in rules.aria_required(t).collect()] == ["a11y.aria.required:slider:aria-valuenow"]
    assert [r.line for r in rules.aria_redundant(t).collect()] == [3]
    assert [(r.actual, r.expected, r.subkind) for r in rules.aria_invalid(t).collect()] == [("buton", "button", "unknownRole")]
    assert [r.line for r in rules.name_missing(t).collect()] == [5]
    assert [r.actual for r in rules.relations(t).collect()] == ["gone"]
    assert [r.actual for r in rules.pattern_focus(t).collect()] == ["One"]


def test_imports_props_tokens_run(spark):
    i = spark.createDataFrame(
        [("a", 1, 1, 0, "lucide-react/icons", [], None, False), ("a", 2, 1, 1, "kit/lib/x", [("Old", "Old", False)], None, False), ("a", 3, 1, 2, "kit/open/y", [], None, False),
         ("a", 4, 1, 3, "base", [], "b", False), ("a", 5, 1, 4, "kit/do-not-use", [], None, True)], schemas.IMPORTS)
    e = elements(spark, ("a", 9, "B", "Button", {"size": "larg", "kind": "plain"}, {}, [], "x"))
    v = styles(spark, ("a.css", 1, "color", "#fffffe", "css", "p", False), ("a.css", 2, "font-family", "Arial, Inter", "css", "p", False), ("a.css", 3, "color", "red !important", "css", "p", True))
    t = rules.Tables(
        style_values=v, elements=e, imports=i, tokens=spark.createDataFrame([("white", "#ffffff", "semantic")], "id string, hex string, tier string"),
        symbols=spark.createDataFrame([("Old", "use New")], "name string, note string"), kit_packages=spark.createDataFrame([("kit", [".", "./open/*"])], "package string, exports array<string>"),
        upstream=spark.createDataFrame([("base", "Wrap")], "package string, wrapper string"), variants=spark.createDataFrame([("Button", "size", ["small", "large"])], "component string, prop string, legal array<string>"))
    found = rules.run_rules(t)
    rows = found.collect()
    got = {(r.rule, r.actual, r.expected) for r in rows}
    assert {("icon.foreign-pack", "lucide-react/icons", None), ("import.internal", "kit/lib/x", None), ("import.bypass", "base", "Wrap"), ("api.dnu", "kit/do-not-use", None), ("api.deprecated", "Old", "use New"),
            ("prop.invalid", "larg", "large"), ("token.literal.color", "#fffffe", "white"), ("font.foreign", "Arial, Inter", None), ("style.override.important", "color: red !important", "color")} <= got
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == [f"f_{k:04d}" for k in range(1, len(rows) + 1)]
    assert sinks.per_file_json(found).count() == 2 and sinks.compact(found).count() == len(rows)
    assert sinks.summary(found, 3).first()["clean"] == 1
    results = [r["result"] for r in sinks.sarif_results(found, spark.createDataFrame([(x,) for x in rules.REGISTRY], "id string")).collect()]
    assert '"version": "2.1.0"' in sinks.sarif_document(results, list(rules.REGISTRY), "sparkloom")


def test_duplicates(spark):
    sig = [f"t{i % 9}" for i in range(60)]
    d = spark.createDataFrame([("a", 1, 1, 0, "Card", "component", [], [], [], [], sig, 1, 2, [], []), ("b", 1, 1, 1, "Box", "component", [], [], [], [], sig, 1, 5, [], []), ("c", 1, 1, 2, "Other", "component", [], [], [], [], [f"u{i}" for i in range(60)], 1, 1, [], [])], schemas.DECLARATIONS)
    used = [(f, n, x, None, {}, {}, [], None) for f, n, x in [("p", 1, "Card"), ("p", 2, "Card"), ("p", 3, "Box"), ("q", 4, "Box"), ("q", 5, "Other"), ("q", 6, "Other"), ("q", 7, "Other")]]
    e = elements(spark, *used)  # as many uses of both, in more files of one
    assert [(r.actual, r.expected) for r in rules_kit.component_duplicate(rules.Tables(declarations=d, elements=e)).collect()] == [("Box", "2")]


def test_files_and_stylesheets(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules/x").mkdir(parents=True)
    (tmp_path / "src/a.scss").write_text("$v: 1px;\n.a {\n  color: red; // no: thing\n  &:hover { outline: none !important; }\n  background: url(data:x;y);\n}\n")
    (tmp_path / "src/big.css").write_text("a{}" * 400_000)
    (tmp_path / "node_modules/x/b.css").write_text("a{color:red}")
    (tmp_path / "src/skip.css").write_text("a{color:red}")
    small, large = files.split_by_size(files.list_files(spark, str(tmp_path), ["skip.*"]))
    assert [r.file for r in large.collect()] == ["src/big.css"]
    got = [(r.line, r.property, r.value, r.selector, r.important) for r in stylesheet.style_values(small).orderBy("ord").collect()]
    assert got == [(3, "color", "red", ".a", False), (4, "outline", "none", ".a &:hover", True), (5, "background", "url(data:x;y)", ".a", False)]
    assert files.source_lines(small).count() == 6
    # what the scanner gives is what rules take
    scanned = stylesheet.style_values(small)
    assert scanned.schema.simpleString() == spark.createDataFrame([], schemas.STYLE_VALUES).schema.simpleString()
    assert [(r.rule, r.subkind) for r in rules.run_rules(rules.Tables(style_values=scanned), ["a11y"]).collect()] == [("a11y.focus.suppressed", "blanket")]
    row = scanned.where("property = 'outline'").first()
    assert (row.value, row.authored, row.classNames, row.dynamic, row.appliedTo) == ("none", "none !important", ["a"], False, None)


def test_ignore_files_scope_and_extensions(spark, tmp_path):
    for path, content in {
            ".gitignore": "*.gen.css\n# note\n/top\n", ".dsignore": "legacy/\n", "a.styl": "x", "b.pcss": "x", "c.gen.css": "x", "top/d.css": "x", "src/top/e.css": "x", "src/.gitignore": "local.css\n!keep.gen.css\n",
            "src/local.css": "x", "local.css": "x", "src/keep.gen.css": "x", "legacy/f.css": "x", "srcx/g.css": "x", ".turbo/h.css": "x", "src/i.snap": "x", "out/j.css": "x", "src/k.d.ts": "x", "src/_part.scss": "x", ".story/l.ts": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    every = lambda **k: sorted(r.file for r in files.list_files(spark, str(tmp_path), **k).select("file").collect())
    assert every() == [".story/l.ts", "a.styl", "local.css", "src/_part.scss", "src/keep.gen.css", "src/top/e.css", "srcx/g.css"]
    assert every(scope="src") == ["src/_part.scss", "src/keep.gen.css", "src/top/e.css"] and every(scope="local.css") == ["local.css"] and every(patterns=["srcx/", "!c.gen.css"]) == [".story/l.ts", "a.styl", "c.gen.css", "local.css", "src/_part.scss", "src/keep.gen.css", "src/top/e.css"]


def test_configs_aliases_and_roots(spark, tmp_path):
    (tmp_path / "base.json").write_text('{ // shared\n "compilerOptions": {"baseUrl": ".", "strict": true, "paths": {"@/*": ["src/*"],},}, }')
    (tmp_path / "app").mkdir()
    (tmp_path / "app/tsconfig.json").write_text('{"extends": "../base", /* own */ "compilerOptions": {"strict": false, "url": "a//b"}}')
    (tmp_path / "loop.json").write_text('{"extends": "./loop.json", "compilerOptions": {"jsx": "react"}}')
    (tmp_path / "package.json").write_text('{"name": "p", "imports": {"#lib/*": "./lib/*", "@/*": "./other/*"}}')
    assert configs.read_config(str(tmp_path / "app/tsconfig.json")) == {"baseUrl": ".", "strict": False, "paths": {"@/*": ["src/*"]}, "url": "a//b"}
    assert configs.read_config(str(tmp_path / "loop.json")) == {"jsx": "react"} and configs.read_config(str(tmp_path / "none.json")) == {}
    assert configs.aliases(configs.read_config(str(tmp_path / "app/tsconfig.json")), {"imports": {"#lib/*": "./lib/*", "@/*": "./other/*"}}) == {"@/*": "src/*", "#lib/*": "lib/*"}
    assert configs.project_root(str(tmp_path / "app")) == str(tmp_path)
    known = spark.createDataFrame([("src/a.ts",), ("src/b/index.tsx",), ("lib/c.js",)], "file string")
    used = spark.createDataFrame([("src/x.ts", "./a"), ("src/x.ts", "./b"), ("src/x.ts", "@/a"), ("src/x.ts", "#lib/c"), ("src/x.ts", "react"), ("src/x.ts", "../../../up"), ("src/x.ts", "./none")], "file string, specifier string")
    got = {(r.specifier, r.kind, r.target) for r in configs.resolve_modules(used, known, {"@/*": "src/*", "#lib/*": "lib/*"}).collect()}
    assert got == {("./a", "file", "src/a.ts"), ("./b", "file", "src/b/index.tsx"), ("@/a", "file", "src/a.ts"), ("#lib/c", "file", "lib/c.js"), ("react", "package", "react"), ("../../../up", "unresolved", None), ("./none", "unresolved", None)}
