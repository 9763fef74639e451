import math
import re

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import style, text
from sparkloom.operators import components
from sparkloom.plans import rules, rules_kit
from tests.test_rules import elements, styles

SIGNATURES = (
    "name string, synonyms array<string>, propSignature array<string>, propWeights map<string,double>, ariaRoles array<string>, ariaAttributes array<string>, nativeTags array<string>, "
    "cssProperties array<string>, astSignature array<string>")


def test_registry_has_every_rule_once():
    rules.applicable(rules.Tables())
    wanted = (
        "a11y.aria.invalid a11y.aria.redundant a11y.aria.required a11y.contrast.text a11y.focus.suppressed a11y.lint a11y.name.missing a11y.pattern.focus a11y.pattern.keyboard a11y.pattern.relations api.deprecated api.dnu "
        "component.ambiguous component.custom component.duplicate component.fork component.novel font.foreign icon.foreign-file icon.foreign-pack icon.inline-svg import.bypass import.internal prop.invalid "
        "style.override.important style.override.inner style.override.repaint style.override.size token.literal.color token.literal.dimension token.tier.violation token.typography.partial").split()
    assert sorted(rules.REGISTRY) == wanted and len(wanted) == 32


def test_focus_in_any_spelling(spark):
    v = styles(spark, ("a", 1, "outline", "0 none red", "css", "[data-focused]", False), ("b", 1, "outline", "none", "css", "*", False), ("b", 2, "border", "1px", "css", "&.is-focused", False),
               ("c", 1, "outline", "none", "css", "x", False), ("c", 2, "box-shadow", "none", "css", "x", False), ("d", 1, "outline", "none", "jss", "x", False))
    assert sorted((r.file, r.subkind) for r in rules.focus_suppressed(rules.Tables(style_values=v)).collect()) == [("a", "onFocus")]


def test_dimensions(spark):
    rows = [("a", 1, "font-size", "15px", "css", "p", False), ("a", 2, "font-size", "1rem", "css", "p", False), ("a", 3, "border", "3px solid", "css", "p", False), ("a", 4, "width", "7px", "css", "p", False),
            ("a", 5, "border-radius", "0 50% url(4px) /* 9px */", "css", "p", False), ("a", 6, "line-height", "2em", "css", "p", False)]
    rows += [("b", i, "padding", "8px", "css", "q", False) for i in range(13)] + [("b", 20, "gap", "13px", "css", "q", False)]
    scales = spark.createDataFrame([("fontSizePx", 14.0, "s"), ("fontSizePx", 16.0, "m"), ("fontSizePx", 20.0, "l"), ("borderWidthPx", 1.0, "thin")], "scale string, px double, token string")
    got = {(r.file, r.line, r.subkind, r.severity, r.confidence, r.expected) for r in rules_kit.literal_dimension(rules.Tables(style_values=styles(spark, *rows), scales=scales)).collect()}
    assert got == {("a", 1, "offScale", "warning", 1.0, "14,16"), ("a", 2, "onScale", "info", 1.0, "m"), ("a", 3, "offScale", "warning", 1.0, "1"), ("a", 6, "offScale", "warning", 1.0, None),
                   ("b", 20, "noScale", "warning", 0.7, None)} | {("b", i, "noScale", "info", 0.5, None) for i in range(13)}


def test_tiers(spark):
    palette = spark.createDataFrame(
        [("p.red", "--red", "primitive", "#f00", None), ("s.bg", "--bg", "semantic", "#ff0000", "background"), ("s.fg", "--fg", "semantic", "#ff0000ff", "foreground"), ("p.blue", "--blue", "primitive", "#00f", None),
         ("p.r", "--radius", "primitive", "4px", None)], "id string, cssVariable string, tier string, hex string, role string")
    v = styles(spark, ("a", 1, "color", "var(--red)", "css", "p", False), ("a", 2, "border", "1px solid var( --red)", "css", "p", False), ("a", 3, "box-shadow", "0 0 var(--red)", "css", "p", False),
               ("a", 4, "color", "var(--blue)", "css", "p", False), ("a", 5, "border-radius", "var(--radius)", "css", "p", False), ("a", 6, "background", "var(--bg)", "css", "p", False))
    got = sorted((r.line, r.actual, r.expected, r.impactKey) for r in rules_kit.tier_violation(rules.Tables(style_values=v, palette=palette)).collect())
    assert got == [(1, "--red", "--fg", "token.tier.violation:--red"), (3, "--red", "--bg", "token.tier.violation:--red")]


def test_typography(spark):
    tuples = spark.createDataFrame([("Body", "Inter", "14px", "400", "20px", None), ("Title", "Inter", "24px", "700", "32px", None)], "id string, fontFamily string, fontSize string, fontWeight string, lineHeight string, letterSpacing string")
    block = lambda f, *p: [(f, i + 1, k, v, "css", ".x", False) for i, (k, v) in enumerate(p)]
    v = styles(spark, *block("a", ("font-size", "14px"), ("font-weight", "400"), ("line-height", "21px")), *block("b", ("font-size", "14px"), ("font-weight", "400"), ("line-height", "20px")),
               *block("c", ("font-size", "14px"), ("line-height", "21px")), *block("d", ("font-family", "Arial"), ("font-size", "14px"), ("font-weight", "400"), ("line-height", "21px")),
               *block("e", ("font-size", "13px"), ("font-weight", "400"), ("line-height", "21px")), *block("f", ("font-family", "'inter'"), ("font-size", "24px"), ("line-height", "31px")))
    got = sorted((r.file, r.line, r.actual, r.impactKey, r.expected) for r in rules_kit.partial_typography(rules.Tables(style_values=v, typography=tuples)).collect())
    assert got == [("a", 1, "14px/21px/400", "token.typography.partial:Body", "lineHeight 21px for 20px"), ("f", 1, "24px/31px", "token.typography.partial:Title", "lineHeight 31px for 32px")]


def test_keyboard(spark):
    e = elements(spark, ("a", 1, "div", None, {"role": "menu"}, {}, [], None), ("a", 2, "div", None, {"role": "menu"}, {}, ["Enter"], None), ("a", 3, "M", "Menu", {"role": "menu"}, {}, [], None),
                 ("a", 4, "div", None, {"role": "tree"}, {}, [], None), ("a", 5, "div", None, {"role": "dialog"}, {}, [], None)).withColumn("eventHandlers", F.when(F.col("line") == 1, F.array(F.lit("onKeyDown"))).otherwise(F.col("eventHandlers")))
    p = spark.createDataFrame([("MenuList", ["menu"], ["x"]), ("Menu", ["menu", "grid"], ["ArrowDown"]), ("Tree", ["tree"], [])], "component string, roles array<string>, keysHandled array<string>")
    assert [(r.line, r.subkind, r.severity, r.expected) for r in rules_kit.pattern_keyboard(rules.Tables(elements=e, patterns=p)).collect()] == [(1, "handlerUnreadable", "warning", "Menu")]


def fingerprint(shapes):
    h = 0x811C9DC5
    for c in "|".join(shapes):
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_icons(spark):
    one = '<svg viewBox="0 0 24 24"><path id="q" d="M1.001,2 L 3.456 -4.5Z"/><circle cx="1.5" cy=\'2\' r="3.00"/></svg>'
    prints = spark.createDataFrame([(one,), ("<svg>{x}</svg>",), (None,), ('<svg><polygon points="1,2  3,4"/><rect width="2"/></svg>',)], "s string").select(style.svg_fingerprint(F.col("s"))).collect()
    assert [r[0] for r in prints] == [fingerprint(["path:M1 2L3.46 -4.5Z", "circle:1.5 2 3"]), None, None, fingerprint(["polygon:1 2 3 4", "rect:  2   "])]
    icons = spark.createDataFrame([("zoom", 16, prints[0][0]), ("add", 24, prints[0][0]), ("add", 16, prints[0][0])], "name string, size int, fingerprint string")
    e = elements(spark, ("a.tsx", 2, "svg", None, {}, {}, [], None), ("a.tsx", 9, "svg", None, {}, {}, [], None), ("b.tsx", 1, "svg", None, {}, {}, [], None))
    lines = [("a.tsx", i + 2, x) for i, x in enumerate(one.replace("><", ">\n<").split("\n"))] + [("a.tsx", 9, "<svg>{draw()}</svg>"), ("a.tsx", 1, "x")]
    t = rules.Tables(
        elements=e, source_lines=spark.createDataFrame(lines, "file string, line int, text string"), icons=icons, style_values=styles(spark, ("s/c.css", 1, "background", "url('../i/one.svg?x') url(none.svg)", "css", "p", False)),
        imports=spark.createDataFrame([("s/d.ts", 1, 1, 0, "./e.svg", [], "e", False), ("s/d.ts", 2, 1, 1, "svg", [], "e", False)], schemas.IMPORTS),
        svg_files=spark.createDataFrame([("i/one.svg", one), ("s/e.svg", '<svg><line x1="1" x2="2"/></svg>')], "file string, content string"))
    assert sorted((r.file, r.line, r.subkind, r.severity, r.impactKey) for r in rules_kit.inline_svg(t).collect()) == [
        ("a.tsx", 2, "kit-icon", "warning", "icon.inline-svg:add"), ("a.tsx", 9, "no-match", "candidate", "icon.inline-svg:a.tsx:9"), ("b.tsx", 1, "no-match", "candidate", "icon.inline-svg:b.tsx:1")]
    assert sorted((r.actual, r.subkind, r.impactKey) for r in rules_kit.foreign_svg_file(t).collect()) == [
        ("../i/one.svg?x", "kit-icon", "icon.foreign-file:add"), ("./e.svg", "no-match", "icon.foreign-file:" + fingerprint(["line:1  2 "])), ("none.svg", "no-match", "icon.foreign-file:none.svg")]


def declared(spark, *rows):
    full = [(f, i + 1, 1, i, n, "component", props, roles, attrs, tags, sig, 1, 0, used, css) for i, (f, n, props, roles, attrs, tags, sig, used, css) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.DECLARATIONS)


def test_components(spark):
    sig = [f"t{i}" for i in range(60)]
    near = [*sig[:55], *(f"z{i}" for i in range(5))]
    signatures = spark.createDataFrame(
        [("Card", ["Panel"], ["accent", "elevation", "draggable", "classes"], {"accent": 2.0, "elevation": 1.0}, ["region"], ["aria-label", "aria-busy"], ["button", "input", "div"], ["color", "margin"], sig),
         ("Spinner", [], ["size"], {}, ["progressbar"], [], [], [], None)], SIGNATURES)
    d = declared(
        spark, ("a", "Copied", [], [], [], [], near, [], []), ("a", "OldCard", ["accent", "elevation", "draggable", "x"], [], [], [], None, [], []), ("a", "Cards", ["accent", "elevation"], ["region"], ["aria-busy", "aria-label"], ["button", "input"], None, [], []),
        ("a", "Cart", [], [], [], [], None, [], []), ("a", "Wheel", [], [], [], [], None, [], []), ("a", "Holder", [], ["region"], [], [], None, ["Card"], []), ("a", "TwinOne", [], [], [], [], [f"u{i}" for i in range(60)], [], []),
        ("a", "TwinTwo", [], [], [], [], [f"u{i}" for i in range(60)], [], []), ("b", "Wheel", ["size"], [], [], [], sig, [], []))
    e = elements(spark, *(("f%d" % (i % 3), i, "Wheel", None, {}, {}, [], None) for i in range(5)))
    t = rules.Tables(declarations=d, elements=e, signatures=signatures)
    got = {(r.rule, r.actual, r.expected) for f in (rules_kit.component_fork, rules_kit.component_custom, rules_kit.component_ambiguous, rules_kit.component_novel) for r in f(t).collect()}
    rank = str(math.floor(5 * math.log(4) * 100 + 0.5) / 100)
    twin = str(math.floor(math.log(2) * 2 * 100 + 0.5) / 100)
    assert got == {("component.fork", "Copied", "Card"), ("component.fork", "OldCard", "Card"), ("component.custom", "Cards", "Card"), ("component.ambiguous", "Cart", None), ("component.novel", "Wheel", rank),
                   ("component.novel", "TwinOne", twin), ("component.novel", "TwinTwo", twin)}


def plain(name):
    return re.sub("^(?:My|App|Custom|Base|New|Ui|Common|Styled|Wrapped|Legacy|Old)+|(?:V[0-9]+|Component|Wrapper)$", "", name).lower()


@pytest.mark.parametrize("local,score", [("Card", 1.0), ("MyPanel", 0.9), ("BigCardList", 0.75), ("SidePanelX", 0.65), ("Carf", 0.55), ("Boxes", None), ("CardV2", 1.0)])
def test_name_score(spark, local, score):
    row = spark.createDataFrame([(local,)], "n string").select(components.name_score(F.col("n"), F.lit("Card"), F.array(F.lit("Panel"))), text.normalise_name(F.col("n"))).first()
    assert row[0] == score and row[1] == plain(local)


def test_overrides(spark):
    v = styles(spark, ("a", 1, "color", "red", "css", ".x", True), ("a", 2, "background", "blue", "css", ".x", True), ("a", 3, "height", "3px", "css", ".x", True), ("a", 4, "margin", "3px", "css", ".x", True),
               ("a", 5, "width", "1px !IMPORTANT", "css", ".x", True), ("a", 6, "color", "red", "css", ".y", False)).unionByName(
        spark.createDataFrame([("b", 1, 1, 9, "margin", "0", "0", "css", ".z", [], False, False, ("kit", "Button", "icon")), ("b", 2, 1, 10, "color", "red", "red", "css", ".w", [], False, False, ("kit", "Button", "root"))], schemas.STYLE_VALUES))
    t = rules.Tables(style_values=v, slots=spark.createDataFrame([("Button", "icon", True), ("Button", "root", False)], "component string, slot string, inner boolean"))
    got = sorted((r.rule, r.file, r.line, r.severity, r.confidence, r.expected, r.impactKey) for f in (rules_kit.override_important, rules_kit.override_inner, rules_kit.override_repaint, rules_kit.override_size) for r in f(t).collect())
    assert got == [("style.override.important", "a", 5, "error", 1.0, "width", "style.override.important:Button"), ("style.override.inner", "b", 1, "error", 1.0, "margin", "style.override.inner:Button.icon"),
                   ("style.override.repaint", "a", 1, "warning", 0.9, "color, background", "style.override.repaint:Button"), ("style.override.repaint", "b", 2, "warning", 0.9, "color", "style.override.repaint:Button"),
                   ("style.override.size", "a", 3, "info", 0.7, "height", "style.override.size:Button")]
