"""Variant sets, types and deprecated paths of hand-made scripts."""

from sparkloom.sources import typed

A = """
import { x } from 'y'
/** Sizes. */
export const Size = {
  /** @deprecated use m */
  s: 'small', // @deprecated as a tail of s
  'm-x': "it's",
  n: -1.5, ok: true, [key]: 'c', other: call({ a: 1, b: 2 }),
  ...rest, short, f() { return { a: 1 } },
} as const
export const Loose = { a: 'b' }
const Hidden = { a: 'b' } as const
export const Empty = {} as const
/**
 * Old.
 * @deprecated
 */
export type Tone =
  | 'calm' // a comment
  | "loud"
export type One = 'one'
export type Mixed = 'a' | number
type Secret = 'a' | 'b'
// export type Commented = 'a' | 'b'
const text = "export type Quoted = 'a' | 'b'"
"""
B = """
/** A box.
 * @deprecated gone */
export interface BoxProps<T extends string = 'a'> extends Base<T, 'x'>, Other {
  /** How big;
   *  very. */
  size?: keyof typeof Size; tone: Tone | 'c' | undefined
  readonly 'aria-label': string,
  /** @deprecated */
  onChange?: (e: Event, more: { a: 1; b: 2 }) => void
  call(x: number): string
  wide:
    | 'left'
    | 'right'
  map: Record<string, number>
  [key: string]: unknown
  last: (typeof Size)[keyof typeof Size]
}
interface PrivateProps { a: string }
export type LinkProps = Omit<BoxProps<'a'>, 'size' | 'tone'> & {
  href: string
} & More
export type BoxClasses = { root: string; /** The icon. */ icon?: string } & RootClasses;
export type Kind = 'x' | 'y'
"""
C = """
export const edsSys = {
  bg: {
    // @deprecated
    a: '1', b: '2', // @deprecated tail
    c: '3',
    /* @deprecated */
    'd.e': { f: '1',
      /** @deprecated in depth */
      g: fn({ h: 1 }) },
  },
}
const edsRef = {
  /** @deprecated */
  x: 1 }
"""


def files(spark, **texts):
    return spark.createDataFrame([(n + ".ts", t.encode() if isinstance(t, str) else t) for n, t in texts.items()], "file string, content binary")


def test_variant_sets(spark):
    got = {r.name: (r.line, r.kind, r["keys"], r["values"], r.deprecatedKeys) for r in typed.variant_sets(files(spark, a=A, bad=b"\xff\xfe", empty="", open="export const X = { a: 'b' ")).collect()}
    assert got == {
        "Size": (4, "constObject", ["s", "m-x", "n", "ok", "[key]", "other"], {"s": "small", "m-x": "it's", "n": "-1.5", "ok": "true", "[key]": "c"}, ["s"]),
        "Tone": (18, "literalUnion", ["calm", "loud"], {}, ["calm", "loud"])}


def test_types(spark):
    rows = {r.name: r for r in typed.props_types(files(spark, b=B)).collect()}
    assert list(rows) == ["BoxProps", "LinkProps"]
    box = rows["BoxProps"]
    assert (box.line, box.extends, box.doc, box.deprecated) == (4, ["Base<T, 'x'>", "Other"], "A box.", True)
    assert [tuple(m) for m in box.members] == [
        ("size", True, "keyof typeof Size", "How big; very.", False), ("tone", False, "Tone | 'c' | undefined", None, False), ("aria-label", False, "string", None, False),
        ("onChange", True, "(e: Event, more: { a: 1; b: 2 }) => void", None, True), ("call", False, "(x: number): string", None, False), ("wide", False, "| 'left' | 'right'", None, False),
        ("map", False, "Record<string, number>", None, False), ("last", False, "(typeof Size)[keyof typeof Size]", None, False)]
    link = rows["LinkProps"]
    assert link.extends == ["Omit<BoxProps<'a'>, 'size' | 'tone'>", "More"] and [m.name for m in link.members] == ["href"]
    slots = typed.slot_sets(files(spark, b=B)).collect()
    assert [(r.name, r.extends, [(m.name, m.optional, m.doc) for m in r.members]) for r in slots] == [("BoxClasses", ["RootClasses"], [("root", False, None), ("icon", True, "The icon.")])]


def test_deprecated_paths(spark):
    got = [(r.line, r.path) for r in typed.deprecated_paths(files(spark, c=C), "edsSys").collect()]
    assert got == [(5, "bg.a"), (8, "bg.d.e"), (10, "bg.d.e.g")]


def test_legal_values(spark):
    good = A.replace("n: -1.5, ok: true, [key]: 'c', other: call({ a: 1, b: 2 }),", "")
    both = files(spark, a=good, b=B, c="export type Tone = 'own' | 'two'\nexport interface TagProps { tone?: Tone | null; n: number | 'a'; far: Kind; gone: Nowhere }")
    got = {(r.component, r.prop): r.legal for r in typed.legal_values(typed.props_types(both), typed.variant_sets(both)).collect()}
    assert got == {
        ("Box", "size"): ["m-x", "s"], ("Box", "tone"): ["c", "calm", "loud"], ("Box", "wide"): ["left", "right"], ("Box", "last"): ["it's", "small"],
        ("Tag", "tone"): ["own", "two"], ("Tag", "far"): ["x", "y"]}
    assert typed.legal_values(typed.props_types(both).limit(0), typed.variant_sets(both)).count() == 0
