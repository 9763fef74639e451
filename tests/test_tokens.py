"""Tokens of hand-made themes: odd trees, references that end nowhere, empty and null input."""

import json

import pytest

from sparkloom.operators import tokens
from sparkloom.scratch import cut

SHAPE = "kit string, tier string, mode string, file string, tree string"
REF = {
    "palette": {"pink": {"p500": "#ff1f78", "deep": {"er": {"est": "#000"}}}}, "fontSize": {"s": 12, "m": "1rem"}, "fontFamilies": {"a": 'Inter, "Sans" \\ x'}, "list": ["1px", ["2px"]],
    "borderRadius": {"none": 0}, "nothing": None, "empty": {}, "none": [], "yes": True, "bad": "NaN", "shade": {"shadow": "0px 1px black"}}
LIGHT = {"bg": {"accent": "{edsRef.palette.pink.p500}", "gone": "{edsRef.nope}", "loop": "{edsSys.bg.loop2}", "loop2": "{edsSys.bg.loop}", "toLoop": "{edsSys.bg.loop}", "viaGone": "1px {edsSys.bg.gone}", "two": "{edsSys.bg.accent} {edsRef.fontSize.m}"}}
DARK = {"bg": {"accent": "rgba({edsRef.palette.pink.p500}, 0.06)"}}
COMP = {"button": {"colorBackgroundContainedPrimaryCheckedHover": "{edsSys.bg.accent}", "closeButtonShapeBorderRadiusTopLeftMd": "4px", "weird": "{unknown.x}"}}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("k", "ref", None, "a", json.dumps(REF)), ("k", "sys", "light", "b", json.dumps(LIGHT)), ("k", "sys", "dark", "b", json.dumps(DARK)), ("k", "comp", None, "c", json.dumps(COMP)),
            ("k", "ref", None, "z", json.dumps({"fontSize": {"s": 14}})), ("k", "ref", None, "q", "{no"), ("k", "ref", None, "q", None), ("k", "ref", None, "q", "3"),
            (None, "ref", None, None, '{"spacing": {"a": "3px"}, "p": "{edsRef.spacing.a}"}')]
    frame = cut(tokens.extract_tokens(spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS path", "2 AS value"), "sds"))
    return frame, {(r.kit, r.id): r for r in frame.collect()}


def test_leaves_of_any_depth(found):
    rows = found[1]
    values = {i: (r.authored.light, r.type, r.kind) for (k, i), r in rows.items() if k == "k" and i.startswith("ref.")}
    assert values == {
        "ref.palette.pink.p500": ("#ff1f78", "string", "color"), "ref.palette.pink.deep.er.est": ("#000", "string", "color"), "ref.fontSize.s": ("14", "number", "fontSize"), "ref.fontSize.m": ("1rem", "string", "fontSize"),
        "ref.fontFamilies.a": ('Inter, "Sans" \\ x', "string", "fontFamily"), "ref.list.0": ("1px", "string", "dimension"), "ref.list.1.0": ("2px", "string", "dimension"), "ref.borderRadius.none": ("0", "number", "dimension"),
        "ref.nothing": (None, "null", "unknown"), "ref.yes": ("true", "boolean", "unknown"), "ref.bad": ("NaN", "string", "unknown"), "ref.shade.shadow": ("0px 1px black", "string", "shadow")}
    assert rows["k", "ref.bad"].anomalies == ["non-finite-number"] and not rows["k", "ref.yes"].anomalies


def test_references_resolve_by_tier_and_mode(found):
    got = {i: (r.resolved.light, r.resolved.dark) for (k, i), r in found[1].items() if r.tier != "ref"}
    pink, faint = "#ff1f78", "rgba(#ff1f78, 0.06)"
    assert got == {
        "sys.bg.accent": (pink, faint), "sys.bg.two": (pink + " 1rem", faint + " 1rem"), "sys.bg.gone": ("{edsRef.nope}",) * 2, "sys.bg.viaGone": ("1px {edsRef.nope}",) * 2, "sys.bg.loop": ("{edsSys.bg.loop2}",) * 2,
        "sys.bg.loop2": ("{edsSys.bg.loop}",) * 2, "sys.bg.toLoop": ("{edsSys.bg.loop}",) * 2, "comp.button.colorBackgroundContainedPrimaryCheckedHover": (pink, faint),
        "comp.button.closeButtonShapeBorderRadiusTopLeftMd": ("4px",) * 2, "comp.button.weird": ("{unknown.x}",) * 2}
    accent = found[1]["k", "sys.bg.accent"]
    assert accent.themeDependent and accent.color.light == "ff1f78ff" and accent.color.dark == "ff1f780f"
    assert [(r.tier, r.path, r.alpha) for r in accent.references.dark] == [("ref", "palette.pink.p500", 0.06)] and accent.references.light[0].alpha is None
    assert found[1][None, "ref.p"].resolved.light == "3px"


def test_component_keys(found):
    rows = found[1]
    f = rows["k", "comp.button.colorBackgroundContainedPrimaryCheckedHover"].facets
    assert (f.slot, f.category, f.modifiers, f.state, f.size, f.view) == (None, "color", ["background", "contained", "primary"], "checkedHover", None, "contained")
    f = rows["k", "comp.button.closeButtonShapeBorderRadiusTopLeftMd"].facets
    assert (f.slot, f.category, f.modifiers, f.state, f.size, f.view) == ("closeButton", "shape", ["border", "radius", "top", "left", "md"], None, "md", None)
    f = rows["k", "comp.button.weird"].facets
    assert (f.slot, f.category, f.modifiers, f.state) == (None, None, ["weird"], None)


def test_findings_and_scales(found):
    got = {(r.kit, r.code): (r.severity, r["count"], r.samples) for r in tokens.token_diagnostics(found[0]).collect()}
    assert got["k", "spacing-scale-missing"] == ("warning", 9, ["bad", "borderRadius", "fontFamilies", "fontSize", "list", "nothing", "palette", "shade", "yes"]) and (None, "spacing-scale-missing") not in got
    assert got["k", "value-non-finite"] == ("error", 1, ["ref.bad"]) and got["k", "comp-key-unparsed"] == ("info", 1, ["comp.button.weird"])
    assert got["k", "comp-token-literal"] == ("warning", 1, ["comp.button.closeButtonShapeBorderRadiusTopLeftMd"]) and got["k", "reference-unresolved"][1] == 6
    steps = {(r.scale, r.step, r.number) for r in tokens.token_scales(found[0]).where("kit = 'k'").collect()}
    assert {s for s in steps if s[0] != "allDimensionPx"} == {("fontSizePx", "16", 16.0), ("fontSizePx", "14", 14.0), ("borderRadiusPx", "0", 0.0), ("fontFamilies", 'Inter, "Sans" \\ x', None)}


def test_no_trees(spark):
    none = tokens.extract_tokens(spark.createDataFrame([], SHAPE), "sds")
    assert none.count() == 0 and tokens.token_diagnostics(none).count() == 0 and tokens.token_counts(none).count() == 0


def test_chains_and_paths_that_share_a_text(spark):
    """Six tiers of references against plain code; two paths of one text, of which the smaller value counts."""
    ref = {"a.b": "2px", "a": {"b": "1px"}, "deep": {"l1": {"l2": {"l3": {"l4": {"l5": [{"x": True}, {}, []]}}}}}}
    sys_ = {f"s{n}": f"{{edsSys.s{n - 1}}} {n} {{edsRef.a.b}}" for n in range(1, 6)} | {"s0": "{edsRef.a.b}", "x.y": "{edsSys.s5}", "x": {"y": "9px"}, "z": "{edsSys.x.y}"}
    rows = [("k", "ref", None, "a", json.dumps(ref)), ("k", "sys", "light", "b", json.dumps(sys_)), ("k", "sys", "dark", "c", '{"s2": "0px"}'), ("k", "sys", "print", "c", '{"only": "1px"}')]
    got = {(r.id, tuple(r.path)): (r.resolved.light, r.resolved.dark) for r in tokens.extract_tokens(spark.createDataFrame(rows, SHAPE), "sds").collect()}
    light = ["1px"]
    for n in range(1, 6):
        light.append(f"{light[-1]} {n} 1px")
    dark = light[:2] + ["0px"]
    for n in range(3, 6):
        dark.append(f"{dark[-1]} {n} 1px")
    assert {i: v for (i, _), v in got.items() if i.startswith("sys.s")} == {f"sys.s{n}": (light[n], dark[n]) for n in range(6)}
    assert got["sys.x.y", ("x.y",)] == (light[5], dark[5]) and got["sys.x.y", ("x", "y")] == ("9px", "9px")
    assert got["sys.z", ("z",)] == (min(light[5], "9px"), min(dark[5], "9px")) and got["ref.deep.l1.l2.l3.l4.l5.0.x", ("deep", "l1", "l2", "l3", "l4", "l5", "0", "x")] == ("true", "true")
    assert len(got) == 12
