"""Value literals, class links, variables across stylesheets and the closure of re-exports, on small projects."""

import pytest

from sparkloom import schemas
from sparkloom.functions import values
from sparkloom.operators import classes, kit
from sparkloom.plans import rules
from sparkloom.sources import scripts, scss, stylesheet


@pytest.mark.parametrize(("value", "want"), [
    ("1px solid #2969e3", [("dimension", "1px", 0), ("color", "#2969e3", 10)]),
    ("0 0 0 2px #ff2078", [("dimension", "2px", 6), ("color", "#ff2078", 10)]),
    ("11px -13.5REM .5em 4 1.5", [("dimension", "11px", 0), ("dimension", "-13.5REM", 5), ("dimension", ".5em", 14)]),
    ("var(--x, #fff) var( --y-z )", [("var", "--x", 0), ("var", "--y-z", 15)]),
    ("url(data:#fff) /* #000 2px */ gold", [("color", "gold", 30)]),
    ("rgba(0, calc(1 * (2)), 3) x", [("color", "rgba(0, calc(1 * (2)), 3)", 0)]),
    ("rgb(0, 12px", [("dimension", "12px", 7)]),
    ("var(--x", []), ("calc(1px + var(--a))", [("dimension", "1px", 5), ("var", "--a", 11)]),
    ("transparent none currentColor goldfish red-ish", []), ("#ff #12345678 #123456789", [("color", "#12345678", 4)]),
    ("1px/* open #fff", [("dimension", "1px", 0)]), ("10pxx 3% 1e3px", []), ("", []), ("Red", [("color", "Red", 0)])])
def test_reads_literals(value, want):
    assert list(values.read(value)) == want
    assert all(value[o : o + len(r)] == r for k, r, o in want if k != "var")


def test_literals_as_a_table(spark):
    rows = spark.createDataFrame([(1, "1px red", True), (2, None, True), (3, "red", False), (4, "", True)], "raw_id int, value string, words boolean")
    got = values.value_literals(rows, "value", rows["words"]).select("raw_id", "kind", "raw", "offset").collect()
    assert sorted(map(tuple, got)) == [(1, "color", "red", 4), (1, "dimension", "1px", 0)]


def style(spark, *rows):
    """Rows (file, line, property, value, source, selector)."""
    return spark.createDataFrame([(f, n, 1, n, p, v, v, s, x, [], False, False, None) for f, n, p, v, s, x in rows], schemas.STYLE_VALUES)


def test_colour_rule_reads_literals(spark):
    tokens = spark.createDataFrame([("ink", "#000000", "primitive", None), ("text", "#000000", "semantic", "foreground"), ("back", "#000", "semantic", "background"), ("veil", "#00000080", "semantic", None)], "id string, hex string, tier string, role string")
    v = style(spark, ("a.css", 1, "color", "rgb(0, 0, 0)", "css", "p"), ("a.css", 2, "background", "url(#000) #000", "css", "p"), ("a.css", 3, "box-shadow", "0 0 1px black", "css", "p"),
              ("a.css", 4, "fill", "#00000081", "css", "p"), ("a.ts", 5, "color", "black", "ts-literal", None), ("a.css", 6, "color", "#00000020", "css", "p"))
    got = {r.line: (r.column, r.actual, r.subkind, r.expected, r.confidence) for r in rules.literal_color(rules.Tables(style_values=v, tokens=tokens)).collect()}
    assert got == {1: (8, "rgb(0, 0, 0)", "exact", "text", 1.0), 2: (23, "#000", "exact", "back", 1.0), 3: (21, "black", "exact", "back", 0.7), 4: (7, "#00000081", "near", "veil", 0.85), 6: (8, "#00000020", "foreign", None, 0.9)}


def files(spark, **content):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), bytearray(v.encode())) for k, v in content.items()], "file string, content binary")


SHEET = """.root { color: red; padding: 4px !important }
.gone { width: 1px }
.label { opacity: 0.5; margin: 0 }
div { color: red }
.kx-text-field-input, .other { color: blue }
.kx-text-field .inner { width: 3px; top: 0 !important }
"""
SCRIPT = """import styles, { other } from './card.module.css';
import { Button } from '@kit/ui';
export const Card = () => <div className={clsx(other.x, styles['box'])}><Button className={styles.root} classes={{ label: clsx(styles.label), icon: styles.none }} /><p className={styles.root} /></div>;
"""


def test_scan_of_styles_and_scripts_gives_all_override_kinds(spark):
    f = files(spark, src__card_dot_module_dot_css=SHEET, src__card_dot_tsx=SCRIPT)
    sheets, code = f.where("file like '%.css'"), f.where("file like '%.tsx'")
    packages = spark.createDataFrame([("@kit/ui", ["."])], "package string, exports array<string>")
    imports = scripts.imports(code)
    elements = scripts.classify(scripts.elements(code), imports, packages)
    refs = classes.style_refs(elements, imports, f)
    assert {(r.module, r.className, r.kind, r.name, r.slot) for r in refs.collect()} == {
        ("src/card.module.css", "box", "host", "div", None), ("src/card.module.css", "root", "kit", "Button", None), ("src/card.module.css", "label", "kit", "Button", "label"),
        ("src/card.module.css", "none", "kit", "Button", "icon"), ("src/card.module.css", "root", "host", "p", None)}
    linked = classes.link_applied_to(stylesheet.style_values(sheets), refs)
    got = {(r.selector, r.property): r.appliedTo and tuple(r.appliedTo) for r in linked.collect()}
    assert got[".root", "color"] == ("kit", "Button", None) and got[".label", "margin"] == ("kit", "Button", "label") and got[".gone", "width"] == ("unused", None, None) and got["div", "color"] is None
    slots = spark.createDataFrame([("Button", "label", True)], "component string, slot string, inner boolean")
    layers = spark.createDataFrame([("text", "Text"), ("text-field", "TextField")], "layer string, component string")
    t = rules.Tables(style_values=linked, slots=slots, kit_classes=layers, class_prefix="kx")
    found = {(r.rule, r.impactKey.partition(":")[2], r.actual) for r in rules.run_rules(t, ["override"]).collect()}
    assert found == {
        ("style.override.repaint", "Button", "color: red"), ("style.override.important", "Button", "padding: 4px"), ("style.override.inner", "Button.label", "opacity: 0.5"),
        ("style.override.repaint", "TextField", "color: blue"), ("style.override.size", "TextField", "width: 3px"), ("style.override.inner", "TextField", "width: 3px"), ("style.override.important", "TextField", "top: 0")}


def test_variables_across_stylesheets(spark):
    f = files(
        spark, s__vars_dot_scss="$brand: #ff1f78;\n$accent: $brand !default;\n$both: $accent $missing;\n$a: $b;\n$b: $a;\n$pad: 4px;\n$pad: 8px;\n", s___mix_dot_scss="@import 'vars';\n$line: 1px solid $accent;\n",
        s__page_dot_scss="@use 'sass:math';\n@use './vars' as v;\n@use 'mix' as *;\n$own: $line, v.$pad;\n", s__deep_dot_scss="".join(f"$d{i}: $d{i + 1};\n" for i in range(9)) + "$d9: 9px;\n")
    declared, _ = scss.variables(f)
    got = {(r.file, r.name): (r.resolved, r.root and tuple(r.root)) for r in declared.collect()}
    assert got["s/_mix.scss", "line"] == ("1px solid #ff1f78", ("s/vars.scss", 1, "brand")) and got["s/page.scss", "own"] == ("1px solid #ff1f78, 8px", ("s/vars.scss", 7, "pad"))
    assert {n for (_, n), v in got.items() if v[0] is None} == {"both", "a", "b", "d0", "d1"}  # d2 is seven references above its literal, the last that eight hops reach
    v = style(spark, ("s/page.scss", 1, "border", "$line", "scss", "p"), ("s/page.scss", 2, "padding", "v.$pad $own", "scss", "p"), ("s/page.scss", 3, "color", "v.$a", "scss", "p"), ("s/page.scss", 4, "color", "red", "scss", "p"), ("s/page.scss", 5, "color", "$brand", "scss", "p"))
    got = {r.line: (r.value, r.rootCause and r.rootCause.name, r.unresolved) for r in scss.resolve_values(v, f).collect()}
    assert got == {1: ("1px solid #ff1f78", "brand", False), 2: ("8px 1px solid #ff1f78, 8px", "pad", False), 3: ("v.$a", None, True), 4: ("red", None, False), 5: ("$brand", None, True)}


def test_closure_of_re_exports(spark):
    f = files(spark, **{
        "a_dot_ts": "export * from '@kit/ui';\nexport { X } from './b';", "b_dot_ts": "export { Button, type Props, Card as Box } from './a';\nexport { T } from '@up/x';", "c_dot_ts": "export { T } from '@up/x';", "d_dot_ts": "export type { P } from './b';", "e_dot_ts": "export * from './c';\nimport z from 'zod';"})
    packages = spark.createDataFrame([("@kit/ui", ["."]), ("@kit/unused", ["."])], "package string, exports array<string>")
    sources = kit.kit_closure(scripts.imports(f), scripts.re_exports(f), f, packages, "@up")
    got = {r.source: (r.kind, r.star, r.names, r.via) for r in sources.collect()}
    assert got == {"@kit/ui": ("package", True, [], ["declared kit package"]), "@up/x": ("wrapped-upstream", True, [], ["wrapped by the kit"]), "a.ts": ("project-barrel", True, ["X"], ["@kit/ui", "b.ts"]),
                   "b.ts": ("project-barrel", False, ["Box", "Button"], ["a.ts"]), "d.ts": ("project-barrel", False, [], ["b.ts"])}
    bound = spark.createDataFrame([("a.ts", "Any"), ("b.ts", "Box"), ("b.ts", "Card"), ("c.ts", "T"), (None, "Q")], "module string, imported string")
    assert {(r.module, r.imported): r.component for r in kit.kit_components(bound, sources).collect()} == {("a.ts", "Any"): "Any", ("b.ts", "Box"): "Box", ("b.ts", "Card"): None, ("c.ts", "T"): None, (None, "Q"): None}
