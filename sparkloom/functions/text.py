"""Names, paths, dimensions, sketches and set similarities as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkloom.functions.numbers import round_half_up

#: Fixed values of 32-bit FNV-1a and of the sketch: lanes, shingle, fewest tokens, golden-ratio seed.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
LANES, SHINGLE, LEAST_TOKENS, GOLDEN = 64, 3, 40, 0x9E3779B1


def fnv1a(text: Column, seed: Column | int = 0) -> Column:
    """Unsigned 32-bit FNV-1a over code points, as a long; the seed is mixed into the offset."""
    start = (F.lit(FNV_OFFSET).cast("long").bitwiseXOR(F.lit(seed).cast("long") if isinstance(seed, int) else seed)).bitwiseAND(F.lit(MASK32).cast("long"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * FNV_PRIME).bitwiseAND(F.lit(MASK32).cast("long")))


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once a row even where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def shingles(tokens: Column, size: int = SHINGLE, separator: str = " ") -> Column:
    return let(tokens, lambda t: F.when(F.size(t) < size, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, size), separator))))


def _fnv_lanes(texts: list[str], seeds: np.ndarray) -> np.ndarray:
    """FNV-1a of each text under each seed: a character at a time, all texts and lanes side by side."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")  # longest first, so the texts still running are a prefix
    points = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint32)
    for row, i in enumerate(order.tolist()):
        points[row, : lengths[i]] = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4")
    running = np.searchsorted(-lengths[order], -np.arange(points.shape[1]), "left")
    hashes = np.tile(np.uint32(FNV_OFFSET) ^ seeds, (len(texts), 1))
    for k, n in enumerate(running.tolist()):
        hashes[:n] ^= points[:n, k, None]
        hashes[:n] *= np.uint32(FNV_PRIME)
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _lane_minima(tokens: pd.Series) -> pd.Series:
    """Lane minima over the shingles of each row, a slice of different shingles at a time."""
    seeds = ((2 * np.arange(LANES, dtype=np.uint64) + 1) * np.uint64(GOLDEN) & np.uint64(MASK32)).astype(np.uint32)
    out = []
    for row in tokens:
        if row is None or len(row) < LEAST_TOKENS:
            out.append(None)
            continue
        found = list({" ".join(t for t in row[i : i + SHINGLE] if t is not None) for i in range(len(row) - SHINGLE + 1)})
        parts = [_fnv_lanes(found[i : i + 4096], seeds).min(axis=0) for i in range(0, len(found), 4096)]
        out.append(np.min(parts, axis=0).astype(np.int64))
    return pd.Series(out)


def minhash(tokens: Column) -> Column:
    """64 lane minima of seeded FNV-1a over 3-shingles, by Arrow batches; null under 40 tokens."""
    return F.pandas_udf(_lane_minima, ArrayType(LongType()))(tokens)


def sketch_similarity(a: Column, b: Column) -> Column:
    """Share of equal lanes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(LANES))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap(a: Column, b: Column, generic: Column | None = None) -> Column:
    """Intersection over the smaller side, generic items left out."""
    if generic is not None:
        a, b = F.array_except(a, generic), F.array_except(b, generic)
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def weight_sum(items: Column, weights: Column, floor: float = 0.1) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.greatest(F.coalesce(weights[x], F.lit(0.0)), F.lit(floor)))


def weighted_jaccard(a: Column, b: Column, weights: Column, least: int = 2) -> Column:
    """Weight of shared items over weight of all, at least ``least`` shared."""
    shared = F.array_intersect(a, b)
    return F.when(F.size(shared) < least, 0.0).otherwise(weight_sum(shared, weights) / weight_sum(F.array_union(a, b), weights))


def weighted_coverage(own: Column, dictionary: Column, weights: Column) -> Column:
    return F.when(F.size(dictionary) == 0, 0.0).otherwise(weight_sum(F.array_intersect(own, dictionary), weights) / weight_sum(F.array_distinct(dictionary), weights))


def package_name(specifier: Column) -> Column:
    """First segment, two for scoped names; null for relative and absolute paths."""
    parts = F.split(specifier, "/")
    return F.when(specifier.rlike(r"^[./]") | (specifier == ""), None).when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def is_deep(specifier: Column) -> Column:
    return package_name(specifier).isNotNull() & (F.length(specifier) > F.length(package_name(specifier)))


def extension_of(path: Column) -> Column:
    """Lower-case extension with its dot; '' for dotfiles and names without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def resolve_reference(base: Column, reference: Column) -> Column:
    """``reference`` from the folder of ``base`` with . and .. resolved; null if it climbs above the root."""
    whole = F.concat(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1), F.split(F.regexp_replace(reference, "[?#].*$", ""), "/"))
    out = F.aggregate(
        whole, F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside")),
        lambda s, x: F.when((x == ".") | (x == ""), s)
        .when(x == "..", F.struct(F.slice(s["path"], 1, F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), (s["inside"] & (F.size(s["path"]) > 0)).alias("inside")))
        .otherwise(F.struct(F.concat(s["path"], F.array(x)).alias("path"), s["inside"].alias("inside"))))
    return F.when(out["inside"], F.array_join(out["path"], "/"))


def css_property(key: Column) -> Column:
    """camelCase to dashes; a leading ms gets its dash."""
    dashed = F.lower(F.regexp_replace(key, "([A-Z])", "-$1"))
    return F.when(key.contains("-"), F.lower(key)).when(dashed.startswith("ms-"), F.concat(F.lit("-"), dashed)).otherwise(dashed)


def class_names(selector: Column) -> Column:
    """Sorted distinct class names of a selector, pseudo-classes left out."""
    plain = F.regexp_replace(selector, r"::?[A-Za-z-]+(\([^)]*\))?", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\.([A-Za-z_][A-Za-z0-9_-]*)"), F.lit(1))))


def pixels(value: Column) -> Column:
    """px of a number with px, rem, em or no unit (4 decimals); null for other units and other text."""
    number = F.regexp_extract(F.trim(value), r"^(-?[0-9]*\.?[0-9]+)(px|rem|em)?$", 1)
    unit = F.regexp_extract(F.trim(value), r"^(-?[0-9]*\.?[0-9]+)(px|rem|em)?$", 2)
    x = F.when(number != "", number.try_cast("double"))
    return round_half_up(F.when(unit.isin("rem", "em"), x * 16).when((unit == "px") | (unit == ""), x), 4)


def normalise_name(name: Column) -> Column:
    """Lower case without the noise of component names (fixed prefixes and suffixes)."""
    return F.lower(F.regexp_replace(name, "^(?:My|App|Custom|Base|New|Ui|Common|Styled|Wrapped|Legacy|Old)+|(?:V[0-9]+|Component|Wrapper)$", ""))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in glob) + "$"


def russian_plural(n: Column, one: str, few: str, many: str) -> Column:
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def english_plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(word + "s")
