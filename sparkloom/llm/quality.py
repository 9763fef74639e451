"""Quality rules: plain word and line rules, then robust multivariate outliers.

For every language and source a minimum-covariance-determinant (MCD) estimate of five transformed statistics is made;
a document whose squared Mahalanobis distance from its group's estimate exceeds ``LIMIT`` is rejected.

The estimate starts from quartiles of each statistic and takes concentration steps: distances from the present
estimate are counted in fine logarithmic bins together with the moments of each bin, and the lowest bins that hold at
least ``SHARE`` of the group give the next estimate, until no group's determinant falls any more. One step is one pass
with one small shuffle, whatever the size of a group: a source with a third of all rows is summed map-side. Statistics
are fixed-point integers, so sums are exact and reruns agree. At last each group's estimate is drawn to the pooled one,
made the same way from all rows, as if that rested on ``PRIOR`` more documents of the group: one rule at every size.

All of it is DataFrame work. Defined results: null and empty texts have no words and fail the base rules; null
languages and sources are groups of their own; repeated rows count as often as they stand there and are judged alike;
very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE_CHARS, cut, drop_cut, let, table, whole, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: One unit of a statistic is 1/SCALE.
SCALE = 1024
P = 5
#: Smallest standard deviation that a statistic is given: log words, log word length, symbols, repeats, doubled lines.
FLOOR = (1.0, 0.10, 0.30, 0.50, 0.50)
#: Share of a group that the estimate rests on, and the factor that makes its covariance consistent for normal data.
SHARE = 0.75
CONSISTENT = 1.41
#: By how much the logarithm of a determinant must fall for another step.
FALL = 1e-3
#: About the 1 - 5e-10 quantile of chi-square with five degrees of freedom.
LIMIT = 52.0
PRIOR = 60
#: Every row counts in its own group and in the pooled one.
GROUP = ["pooled", "lang", "source"]


def _repeat_words(words: Column) -> Column:
    """Words lying in an 8-word window that the text holds twice or more; a window is told by its 64-bit hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        doubled = let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(doubled, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(s, k + 1) - p), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, of))


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns and the base statistics of every document, by its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.select(*keep).columns
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0)
    return docs.select(
        *keep, "lang", "source",
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
    ).select(*kept, "lang", "source", "w.n_words", "word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"),
             "w.n_repeat_words", F.col("l.n").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _transformed(stats: DataFrame) -> DataFrame:
    """x0..x4: the transformed statistics as whole numbers of 1/SCALE, within +-16."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(1 + 100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log(1 + 10 * F.col("n_repeat_words") / n),
        F.log(1 + 10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    ]
    return stats.withColumns({f"x{j}": F.round(F.greatest(F.lit(-16.0), F.least(F.lit(16.0), v)) * SCALE).cast("long") for j, v in enumerate(values)})


PAIRS = [(j, k) for k in range(P) for j in range(k, P)]
CENTRE = [f"m{j}" for j in range(P)]
SPREAD = [f"c{j}{k}" for j, k in PAIRS]
FACTOR = [f"r{j}{k}" for j, k in PAIRS]


def _factored(frame: DataFrame) -> DataFrame:
    """Adds the Cholesky factor r{j}{k} of the covariance c{j}{k}, column by column, and the logarithm of its determinant."""
    for j, k in PAIRS:
        rest = F.col(f"c{j}{k}")
        for i in range(k):
            rest = rest - F.col(f"r{j}{i}") * F.col(f"r{k}{i}")
        frame = frame.withColumn(f"r{j}{k}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if j == k else rest / F.col(f"r{k}{k}"))
    logs = [F.log(f"r{j}{j}") for j in range(P)]
    return frame.withColumn("logdet", sum(logs[1:], logs[0]) * 2)


def _quartile_start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each statistic by group, from exact counts in bins of 1/64."""
    width = SCALE // 64
    long = rows.select(*GROUP, F.posexplode(F.array(*(F.floor(F.col(f"x{j}") / width) for j in range(P)))).alias("j", "bin"))
    counts = long.groupBy(*GROUP, "j", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP, "j")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    middle = (F.col("bin") + 0.5) * width / SCALE
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), middle))
    spread = run.groupBy(*GROUP, "j").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"), F.max("all").alias("n"))
    wide = spread.groupBy(*GROUP).agg(
        F.max("n").alias("n"), *(F.max(F.when(F.col("j") == j, F.col("m"))).alias(f"m{j}") for j in range(P)),
        *(F.max(F.when(F.col("j") == j, F.greatest(F.col("s") * F.col("s"), F.lit(FLOOR[j] ** 2)))).alias(f"c{j}{j}") for j in range(P)))
    return _factored(wide.withColumns({f"c{j}{k}": F.lit(0.0) for j, k in PAIRS if j > k}))


def distance() -> Column:
    """Squared Mahalanobis distance of x0..x4 from m*, by forward substitution with r*."""
    solved: list[Column] = []
    for j in range(P):
        rest = F.col(f"x{j}") / SCALE - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"r{j}{k}") * solved[k]
        solved.append(rest / F.col(f"r{j}{j}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


MOMENTS = ["s", *(f"s{j}" for j in range(P)), *(f"s{j}{k}" for j, k in PAIRS)]


def _estimate(moments: DataFrame) -> DataFrame:
    frame = moments.withColumns({f"m{j}": F.col(f"s{j}") / F.col("s") / SCALE for j in range(P)})
    plain = {(j, k): CONSISTENT * (F.col(f"s{j}{k}") / F.col("s") / (SCALE * SCALE) - F.col(f"m{j}") * F.col(f"m{k}")) for j, k in PAIRS}
    return _factored(frame.withColumns({f"c{j}{k}": F.greatest(c, F.lit(FLOOR[j] ** 2)) if j == k else c for (j, k), c in plain.items()}))


def _step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Moments of the lowest distances that hold SHARE of each group."""
    e = estimate.withColumnsRenamed({g: f"e_{g}" for g in GROUP})
    near = rows.join(e, (rows["pooled"] == e["e_pooled"]) & rows["lang"].eqNullSafe(e["e_lang"]) & rows["source"].eqNullSafe(e["e_source"]))
    binned = near.withColumn("bin", F.floor(16 * F.log2(distance() + 1.0 / 64)))
    sums = binned.groupBy(*GROUP, "bin").agg(
        F.count("*").alias("s"), *(F.sum(f"x{j}").alias(f"s{j}") for j in range(P)),
        *(F.sum(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"s{j}{k}") for k in range(P) for j in range(k, P)))
    w = Window.partitionBy(*GROUP)
    kept = sums.withColumn("before", F.sum("s").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).withColumn(
        "n", F.sum("s").over(w)).where(F.col("before") < SHARE * F.col("n"))
    return kept.groupBy(*GROUP).agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in MOMENTS))


KEPT = ["n", "logdet", *CENTRE, *SPREAD, *FACTOR]


def _concentrated(rows: DataFrame) -> DataFrame:
    """The MCD estimate of every group: steps go on while a determinant falls; groups that are done are left out of them."""
    # the start is no subset's estimate, so the first step is always taken
    now = cut(_quartile_start(rows).withColumn("logdet", F.lit(1e9)).select(*GROUP, *KEPT, F.lit(True).alias("moving")))
    while now.where("moving").limit(1).count():
        before = now
        step = _estimate(_step(rows, before.where("moving").select(*GROUP, *CENTRE, *FACTOR)))
        new = step.select(*(F.col(g).alias(f"to_{g}") for g in GROUP), *(F.col(c).alias(f"to_{c}") for c in KEPT))
        same = F.lit(True)
        for g in GROUP:
            same = same & F.col(g).eqNullSafe(F.col(f"to_{g}"))
        falls = F.coalesce(F.col("to_logdet") < F.col("logdet") - FALL, F.lit(False))
        now = cut(before.join(new, same, "left").select(*GROUP, *(F.when(falls, F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) for c in KEPT), falls.alias("moving")))
        drop_cut(before)
    return now


def estimates(stats: DataFrame) -> DataFrame:
    """Robust estimates by group: e_lang, e_source, the centre and the factor of the covariance, drawn to the pooled ones."""
    values = [F.col(f"x{j}") for j in range(P)]
    passed = stats.where(~F.col("base_failed"))
    rows = passed.select(F.lit(False).alias("pooled"), "lang", "source", *values).unionByName(
        passed.select(F.lit(True).alias("pooled"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *values))
    found = _concentrated(rows)
    pooled = found.where("pooled").first()  # one row, none without rows
    own = found.where(~F.col("pooled"))
    share = F.col("n") / (F.col("n") + PRIOR)
    of = lambda c: F.lit(pooled[c] if pooled else 0.0)
    apart = lambda j: F.col(f"m{j}") - of(f"m{j}")
    drawn = own.select(
        F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), *((share * F.col(c) + (1 - share) * of(c)).alias(c) for c in CENTRE),
        *((share * F.col(f"c{j}{k}") + (1 - share) * of(f"c{j}{k}") + share * (1 - share) * apart(j) * apart(k)).alias(f"c{j}{k}") for j, k in PAIRS))
    out = cut(_factored(drawn).select("e_lang", "e_source", *CENTRE, *FACTOR))
    drop_cut(found)
    return out


def verdicts(stats: DataFrame, own: DataFrame) -> DataFrame:
    """Adds distance2 (null where the base rules decide) and kept."""
    joined = stats.join(own, stats["lang"].eqNullSafe(own["e_lang"]) & stats["source"].eqNullSafe(own["e_source"]), "left")
    return joined.withColumn("distance2", F.when(~F.col("base_failed"), distance())).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= LIMIT))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, kept and distance2 per document."""
    stats = cut(_transformed(statistics(docs, F.col("doc_id"))).withColumn("base_failed", base_failed()))
    return verdicts(stats, estimates(stats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows. Rows and their statistics are written down once, side by side."""
    stats = cut(_transformed(statistics(docs, whole(docs))).withColumn("base_failed", base_failed()).select("_doc", "lang", "source", "base_failed", *(f"x{j}" for j in range(P))))
    return verdicts(stats, estimates(stats)).where("kept").select("_doc.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
