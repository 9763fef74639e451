import time

from sparkloom import schemas
from sparkloom.plans import rules
from sparkloom.sources import scripts

SOURCE = """import React, { useState as use, type FC } from 'react';
import type { T } from "./types";
import './side.css';
import * as Kit from '@kit/ui';
import { Button, Modal as Dialog } from '@kit/ui/lib';
export { A as B, type C } from './a';
export * from './all';
// import { no } from 'comment';
const words = "<b>not a tag</b>"; /* <i>nor</i> */

export const Card = ({ title, onPick, size = 2, ...rest }) => {
  const low = size < 3 && title;
  return (
    <div role="menu" aria-label={'x'} className={cls(a ? "p" : "q")} onKeyDown={(e) => { if (e.key === 'Enter') go(); }} {...rest}>
      <label>Don't <input type="text" disabled tabIndex={-1} /></label>
      <Kit.Icon name="a" />
      <Button onClick={onPick}>
        Save it's
      </Button>
      {list.map((x) => <Dialog key={x} sx={{ color: dark ? '#000' : theme.fg, padding: 4, '&:hover': { opacity: 0.5, zIndex: 3 } }} />)}
    </div>
  );
};

function useThing({ a }) {
  return a as Array<string>;
}

const plain = (x) => x + 1;

export const Box = styled.div`
  color: red; /* c */
  margin: ${(p) => p.gap}px !important;
  ${mixin};
  &:focus { outline: none }
`;
const useStyles = makeStyles((theme) => ({ root: { fontSize: 12, lineHeight: 2, msFlex: 1, border: a ?? '1px solid', 'margin-top': 0 } }));
"""


def files(spark, text=SOURCE):
    return spark.createDataFrame([("a.tsx", bytearray(text.encode())), ("bad.tsx", bytearray(b"\xff\xfe"))], "file string, content binary")


def test_imports_and_re_exports(spark):
    found = scripts.imports(files(spark))
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.IMPORTS).schema.simpleString()
    got = [(r.line, r.specifier, [tuple(n) for n in r.names], r.defaultImport, r.typeOnly) for r in found.orderBy("ord").collect()]
    assert got == [(1, "react", [("useState", "use", False), ("FC", "FC", True)], "React", False), (2, "./types", [("T", "T", False)], None, True), (3, "./side.css", [], None, False), (4, "@kit/ui", [], None, False),
                   (5, "@kit/ui/lib", [("Button", "Button", False), ("Modal", "Dialog", False)], None, False)]
    assert [(r.line, r.specifier, [tuple(n) for n in r.names], r.star) for r in scripts.re_exports(files(spark)).orderBy("ord").collect()] == [(6, "./a", [("B", "A", False), ("C", "C", True)], False), (7, "./all", [], True)]


def test_elements_and_classification(spark):
    found = scripts.elements(files(spark))
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.ELEMENTS).schema.simpleString()
    got = {r.name: r for r in found.collect()}
    assert [r.name for r in found.orderBy("ord").collect()] == ["div", "label", "input", "Kit.Icon", "Button", "Dialog"]
    assert got["div"].props == {"role": "menu", "aria-label": "x"} and got["div"].keysHandled == ["Enter"] and got["div"].eventHandlers == ["onKeyDown"] and set(got["div"].propExpressions) == {"className", "onKeyDown"}
    assert got["input"].props == {"type": "text", "disabled": "true", "tabIndex": "-1"} and got["input"].hasLabelAncestor and not got["Button"].hasLabelAncestor
    assert got["Button"].text == "Save it's" and got["label"].text == "Don't" and got["Button"].propExpressions == {"onClick": "onPick"} and (got["div"].line, got["div"].column) == (14, 5)
    kit = spark.createDataFrame([("@kit/ui", ["."])], "package string, exports array<string>")
    linked = {r.name: (r.resolvedFrom, r.kitComponent) for r in scripts.classify(found, scripts.imports(files(spark)), kit).collect()}
    assert linked == {"div": (None, None), "label": (None, None), "input": (None, None), "Kit.Icon": (None, None), "Button": ("@kit/ui/lib", "Button"), "Dialog": ("@kit/ui/lib", "Modal")}


def test_declarations(spark):
    found = scripts.declarations(files(spark))
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.DECLARATIONS).schema.simpleString()
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"Card", "useThing", "useStyles"} and got["useThing"].kind == "hook" and got["Card"].kind == "component"
    card = got["Card"]
    assert card.props == ["onPick", "size", "title"] and card.ariaRoles == ["menu"] and card.ariaAttributes == ["aria-label"] and card.nativeTags == ["div", "input", "label"] and card.elementCount == 6
    assert card.cssProperties == ["color", "opacity", "padding", "z-index"] and 40 < len(card.astSignature) <= 400


def test_styles(spark):
    found = scripts.style_values(files(spark))
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.STYLE_VALUES).schema.simpleString()
    got = {(r.source, r.selector, r.property, r.value, r.important, r.dynamic) for r in found.collect()}
    assert {x for x in got if x[0] == "inline-style"} == {("inline-style", None, "color", "#000", False, False), ("inline-style", None, "color", "theme.fg", False, True), ("inline-style", None, "padding", "4px", False, False),
                                                         ("inline-style", "&:hover", "opacity", "0.5", False, False), ("inline-style", "&:hover", "z-index", "3", False, False)}
    styled = {(x[2], x[4], x[5], x[1]) for x in got if x[0] == "styled-components"}
    assert styled == {("color", False, False, "&"), ("margin", True, True, "&"), ("outline", False, False, "& &:focus")}
    assert {x[1:4] for x in got if x[0] == "jss"} == {("root", "font-size", "12px"), ("root", "line-height", "2"), ("root", "-ms-flex", "1px"), ("root", "border", "1px solid"), ("root", "margin-top", "0")}
    assert {r.line for r in found.where("property = 'outline'").collect()} == {35}


def test_rules_run_on_scanned_files(spark):
    f = files(spark)
    found = rules.run_rules(rules.Tables(style_values=scripts.style_values(f), elements=scripts.elements(f), imports=scripts.imports(f), declarations=scripts.declarations(f)))
    assert {("a11y.focus.suppressed", "onFocus"), ("a11y.aria.invalid", None)} & {(r.rule, r.subkind) for r in found.collect()}


def test_what_cannot_be_read_is_a_limitation(spark):
    f = files(spark, "const A = () => <div a={ >x;\nconst s = css`color: red;\n")
    assert scripts.elements(f).count() == 0 and {(r.file, r.reason) for r in scripts.limitations(f).collect()} == {("a.tsx", "unsupported-syntax")}
    assert scripts.limitations(files(spark)).count() == 0


def test_long_files_take_linear_time(spark):
    f = files(spark, "export const L = () => (<ul>" + "<li className={x} title='y'>z</li>\n" * 20_000 + "</ul>);")
    assert scripts.elements(f).count() == 20_001


def test_objects_of_any_depth(spark):
    deep = "const useStyles = makeStyles({ root: " + "{ a: " * 3000 + "{ color: 'red' }" + " }" * 3000 + ", last: { margin: 1 } });"
    got = {(r.property, r.value): len(r.selector.split()) for r in scripts.style_values(files(spark, deep)).collect()}
    assert got == {("color", "red"): 3001, ("margin", "1px"): 1}


def test_long_stylesheets_take_linear_time():
    from sparkloom.sources import stylesheet

    text = "".join(f".c{i} {{ color: red;\n padding: 1px }}\n" for i in range(60_000)) + ".u { background: url(data:x;y;(z)); color: blue }"
    began = time.perf_counter()
    rows = stylesheet.scan(text)
    assert time.perf_counter() - began < 10
    assert len(rows) == 120_002 and rows[-1][:4] == (120_001, 37, "color", "blue") and rows[-2][3] == "url(data:x;y;(z))" and rows[119_999][:2] == (120_000, 2)
