"""References of style factories by import, member, template and spread."""

from sparkloom.sources import token_paths

A = """
import { style, recipe, globalStyle } from '@vanilla-extract/css'
import { tokens as t, type Gone } from '@kit/theme'
import * as all from '@kit/theme'
import theme from './theme'
const local = { a: 1 }
export const box = style({
  color: t.sys.color['text-primary'],
  background: all.tokens.sys.back,
  margin: theme.space!,
  padding: `${t.space.s} ${t.space.m}`,
  border: `1px ${local.a}`,
  width: '10px', height: 12, flex: fn(t.x), top: local.a, left: Gone.x,
  gap: [t.gap.old, '2px'],
  outline: dense ? t.a : theme.b,
  fill: t.shades[index],
  stroke: `${t.shades[i]} ${t.ok}`,
  ':hover': { color: t?.hover, ...t.type.body, ...local, ...(x ? t.a : t.b) },
  [`${box} &`]: { zIndex: theme.z },
  // color: t.commented,
})
export const two = style([box, { color: t.two }])
globalStyle('html, body', { color: t.page })
export const button = recipe({ base: { color: t.base }, compoundVariants: [{ variants: { size: 's' }, style: { color: t.compound } }] })
const whole = style({ color: all, ...all })
"""


def found(spark, *texts):
    files = spark.createDataFrame([(n, x.encode()) for n, x in texts], "file string, content binary")
    return token_paths.token_references(files, spark.createDataFrame([("@own/make", "makeStyles")], "module string, name string"))


def test_references(spark):
    references, unread = found(spark, ("a.ts", A))
    got = [(r.owner, r.selector, r.property, r.spread, r.module, r.exportName, ".".join(r.path)) for r in references.orderBy("ord").collect()]
    kit, own = ("@kit/theme", "tokens"), ("./theme", "default")
    assert got == [
        ("box", None, "color", False, *kit, "sys.color.text-primary"), ("box", None, "background", False, *kit, "sys.back"), ("box", None, "margin", False, *own, "space"), ("box", None, "padding", False, *kit, "space.s"),
        ("box", None, "gap", False, *kit, "gap.old"), ("box", None, "outline", False, *kit, "a"), ("box", None, "outline", False, *own, "b"), ("box", None, "stroke", False, *kit, "ok"),
        ("box", ":hover", "color", False, *kit, "hover"), ("box", ":hover", "...", True, *kit, "type.body"), ("box", "[`${box} &`]", "zIndex", False, *own, "z"), ("two", None, "color", False, *kit, "two"),
        (None, "html, body", "color", False, *kit, "page"), ("button", "base", "color", False, *kit, "base"), ("button", "compoundVariants style", "color", False, *kit, "compound")]
    assert [(r.line, r.detail) for r in unread.orderBy("line", "detail").collect()] == [
        (16, "fill: t.shades[index] - computed member in a token reference"), (17, "stroke: `${t.shades[i]} ${t.ok}` - computed member in a token reference"),
        (18, "...(x ? t.a : t.b) - spread is no path of an import"), (18, "...local - spread is no path of an import"), (25, "...all - spread is no path of an import")]


def test_which_files_take_part(spark):
    body = "import { tokens } from 'kit'\n{}\nexport const a = style({ color: tokens.x })\n"
    texts = [("plain.ts", body), ("named.css.ts", body), ("made.ts", body.replace("{}", "import { makeStyles } from '@own/make'", 1)), ("other.ts", body.replace("{}", "import { other } from '@own/make'", 1)),
             ("typed.ts", body.replace("{}", "import type { X } from '@vanilla-extract/css'", 1)), ("broken.css.ts", "import { tokens } from 'kit'\nstyle({ color: tokens.x"), ("empty.css.ts", "")]
    references, unread = found(spark, *texts)
    assert sorted(r.file for r in references.collect()) == ["made.ts", "named.css.ts"] and unread.count() == 0


def test_spreads_against_a_dictionary(spark):
    references, _ = found(spark, ("a.css.ts", "import { t } from 'k'\nexport const a = style({ ...t.one, ...t.two.three, ...t.gone, color: t.none })"))
    known = spark.createDataFrame([("k", "t", ["one"]), ("k", "t", ["two", "three"]), ("z", "t", ["gone"])], "module string, exportName string, path array<string>")
    assert [(r.file, r.line, r.detail) for r in token_paths.unexpandable_spreads(references, known).collect()] == [("a.css.ts", 2, "...t.gone - spread that the dictionary cannot expand")]
