"""Colours: parsing, OKLab and OKLCH, distance, contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.numbers import round_half_up

#: The OKLab matrices (linear sRGB -> LMS, cube-rooted LMS -> Lab).
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: Luminance weights, contrast thresholds for normal and large text, distance classes.
LUMINANCE = (0.2126, 0.7152, 0.0722)
NORMAL_TEXT, LARGE_TEXT = 4.5, 3.0
NEAR, SHADE = 0.02, 0.1


def _from_parts(text: Column) -> Column:
    """Eight hex digits of rgb(...) or rgba(...), with commas or spaces and a slash, numbers or percentages; else null."""
    inner = F.regexp_extract(text, r"^rgba?\(([^()]*)\)$", 1)
    parts = F.filter(F.split(F.replace(inner, F.lit("/"), F.lit(" ")), r"[,\s]+"), lambda x: x != "")

    def number(x: Column, scale: float) -> Column:
        plain = F.regexp_extract(x, r"^([-+]?[0-9]*\.?[0-9]+)%?$", 1).try_cast("double")
        return F.when(plain.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(scale), F.when(x.endswith("%"), plain / 100 * scale).otherwise(plain))))

    two = lambda n: F.lpad(F.lower(F.hex(F.floor(n + 0.5).cast("long"))), 2, "0")
    alpha = F.when(F.size(parts) == 4, number(F.get(parts, F.lit(3)), 1.0)).otherwise(1.0)
    digits = F.concat(*(two(number(F.get(parts, F.lit(i)), 255.0)) for i in range(3)), two(alpha * 255))
    return F.when((inner != "") & F.size(parts).isin(3, 4), digits)


def canonical_hex(text: Column) -> Column:
    """Eight lower-case hex digits of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba(), black, white or transparent; else null."""
    t = F.lower(F.trim(text))
    body = F.substring(t, 2, 8)
    doubled = F.regexp_replace(body, "(.)", "$1$1")
    return (
        F.when(t == "black", "000000ff").when(t == "white", "ffffffff").when(t == "transparent", "00000000")
        .when(t.rlike("^#[0-9a-f]{3}$"), F.concat(doubled, F.lit("ff"))).when(t.rlike("^#[0-9a-f]{4}$"), doubled)
        .when(t.rlike("^#[0-9a-f]{6}$"), F.concat(body, F.lit("ff"))).when(t.rlike("^#[0-9a-f]{8}$"), body).when(t.startswith("rgb"), _from_parts(t)))


def composite(front: Column, back: Column, i: int) -> Column:
    """Channel of a colour with alpha over an opaque one, as 0..255."""
    alpha = round_half_up(channel(front, 3) / 255, 4)
    return F.when(alpha >= 1, channel(front, i)).otherwise(F.floor(channel(front, i) * alpha + channel(back, i) * (1 - alpha) + 0.5).cast("double"))


def channel(hex8: Column, i: int) -> Column:
    """Channel 0..3 (red, green, blue, alpha) as 0..255."""
    return F.conv(F.substring(hex8, 2 * i + 1, 2), 16, 10).cast("double")


def linear(value: Column, knee: float = 0.04045) -> Column:
    """sRGB channel 0..255 to linear light."""
    v = value / 255
    return F.when(v <= knee, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def oklab(red: Column, green: Column, blue: Column) -> list[Column]:
    rgb = [linear(x) for x in (red, green, blue)]
    roots = [F.cbrt(sum((w * x for w, x in zip(row[1:], rgb[1:], strict=True)), row[0] * rgb[0])) for row in LMS]
    return [sum((w * x for w, x in zip(row[1:], roots[1:], strict=True)), row[0] * roots[0]) for row in LAB]


def oklch(red: Column, green: Column, blue: Column) -> list[Column]:
    """Lightness, chroma (5 decimals) and hue in degrees (3 decimals)."""
    lightness, a, b = oklab(red, green, blue)
    hue = F.degrees(F.atan2(b, a))
    return [round_half_up(lightness, 5), round_half_up(F.sqrt(a * a + b * b), 5), round_half_up(F.when(hue < 0, hue + 360).otherwise(hue), 3)]


def distance(first: list[Column], second: list[Column]) -> Column:
    """Euclidean distance in OKLab, 5 decimals."""
    total = None
    for x, y in zip(first, second, strict=True):
        square = (x - y) * (x - y)
        total = square if total is None else total + square
    return round_half_up(F.sqrt(total), 5)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Relative luminance, with the 0.03928 knee of the contrast rules."""
    parts = [w * linear(x, 0.03928) for w, x in zip(LUMINANCE, (red, green, blue), strict=True)]
    return parts[0] + parts[1] + parts[2]


def contrast(first: Column, second: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)


def format_ratio(value: Column) -> Column:
    """Cut to two decimals, with ':1'."""
    return F.concat(F.format_string("%.2f", F.floor(value * 100) / 100), F.lit(":1"))
