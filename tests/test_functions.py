from pyspark.sql import functions as F

from sparkloom.functions import color, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_health_score_of_a_known_report(spark):
    score = numbers.health_score(F.lit(28.75), F.lit(9), F.lit(1 / 15), F.lit(1.0))
    assert one(spark, score) == 59


def test_rounding_is_half_up_in_binary(spark):
    assert one(spark, numbers.round_half_up(F.lit(1.005), 2)) == 1.0


def test_fnv(spark):
    def fnv(s, seed=0):
        h = (2166136261 ^ seed) & 0xFFFFFFFF
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    assert one(spark, text.fnv1a(F.lit("hello"))) == fnv("hello")
    assert one(spark, text.fnv1a(F.lit(""))) == fnv("")
    tokens = [f"t{i % 7}" for i in range(45)]
    sketch = one(spark, text.minhash(F.array(*map(F.lit, tokens))))
    grams = {" ".join(tokens[i : i + 3]) for i in range(43)}
    assert sketch == [min(fnv(g, (2 * i + 1) * 0x9E3779B1 & 0xFFFFFFFF) for g in grams) for i in range(64)]
    assert one(spark, text.minhash(F.array(F.lit("a")))) is None


def test_names_and_paths(spark):
    assert one(spark, text.package_name(F.lit("@a/b/c"))) == "@a/b"
    assert one(spark, text.package_name(F.lit("./b"))) is None
    assert one(spark, text.is_deep(F.lit("x/y"))) is True
    assert one(spark, text.extension_of(F.lit("a/b.TSX"))) == ".tsx"
    assert one(spark, text.extension_of(F.lit("a/.env"))) == ""
    assert one(spark, text.resolve_reference(F.lit("src/a/b.css"), F.lit("../i/./x.svg?v=1"))) == "src/i/x.svg"
    assert one(spark, text.resolve_reference(F.lit("b.css"), F.lit("../x.svg"))) is None
    assert one(spark, text.css_property(F.lit("msTransform"))) == "-ms-transform"
    assert one(spark, text.class_names(F.lit(".b:hover .a.b::after > p"))) == ["a", "b"]
    assert one(spark, text.pixels(F.lit("1.5rem"))) == 24.0
    assert one(spark, text.pixels(F.lit("50%"))) is None
    assert [one(spark, text.russian_plural(F.lit(n), "one", "few", "many")) for n in (1, 3, 11, 12, 21, 25)] == ["one", "few", "many", "many", "one", "many"]


def test_colours(spark):
    assert one(spark, color.canonical_hex(F.lit("#AbC"))) == "aabbccff"
    assert one(spark, color.canonical_hex(F.lit("red-ish"))) is None
    black, white = (color.luminance(*[F.lit(float(v))] * 3) for v in (0, 255))
    assert one(spark, color.format_ratio(color.contrast(black, white))) == "21.00:1"
    lightness, chroma, _ = color.oklch(*[F.lit(255.0)] * 3)
    assert one(spark, lightness) == 1.0 and one(spark, chroma) < 1e-4


def test_similarities(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"), F.lit("x"))
    assert abs(one(spark, text.jaccard(a, b)) - 2 / 3) < 1e-12
    assert one(spark, text.overlap(a, b)) == 1.0
    assert one(spark, numbers.noisy_or(F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5)))) == 0.75


def test_rgb_and_composite(spark):
    rows = ["rgb(1, 2,3)", "rgba(255 0 10 / 50%)", "RGB(100%, 0%, 300)", "rgba(0,0,0,.2)", "rgb(1,2)", "rgb(a,b,c)", "#FfF"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i").select(color.canonical_hex(F.col("s"))).collect()]
    assert got == ["010203ff", "ff000a80", "ff00ffff", "00000033", None, None, "ffffffff"]
    mixed = spark.createDataFrame([("00000033", "ffffffff"), ("102030ff", "ffffffff")], "f string, b string").select(*(color.composite(F.col("f"), F.col("b"), i) for i in range(3))).collect()
    assert tuple(mixed[0]) == (204.0, 204.0, 204.0) and tuple(mixed[1]) == (16.0, 32.0, 48.0)


def test_english_plural(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (5,)], "n int").orderBy("n").select(text.english_plural(F.col("n"), "error")).collect()] == ["errors", "error", "errors"]
