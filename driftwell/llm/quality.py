"""Quality rules and robust multivariate outliers.

Simple rules on counts of words, symbols, repeated lines and repeated word windows come first. What passes them is
held against the other documents of its language and source: the counts become a vector of five transformed
statistics, and the minimum-covariance-determinant estimate of centre and scatter is sought for every group by
concentration steps. A step keeps the three quarters of a group that lie nearest to the present estimate and
estimates anew from them, which never enlarges the determinant. Steps begin from the medians and from the moments of
all rows; the start that ends with the smaller determinant counts. Documents whose Mahalanobis distance, scaled down by
its median, is beyond a chi-square quantile are rejected.

A step is one pass: distances fall into fine logarithmic bins, the moments are summed per bin, and the bins that
hold the nearest three quarters are added up. Statistics are whole thousandths, so all sums are exact and reruns
agree. Groups with fewer than LEAST documents are pooled per language; a pool that is still too small rejects nothing.

Defined cases: a null text has no words and fails the rules; null languages and sources are groups like any other; a
statistic that does not vary in a group gets a least spread (FLOORS), so small deviations are never rejected; rows
that repeat a doc_id count and are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import WORD, join_small, kept_once, pick

LEAST = 100  # documents of a group that is estimated on its own
SHARE = 0.75  # of a group that an estimate rests on
STEPS = 6
BINS = 16  # per unit of the logarithm of the distance
KEYS = ["lang", "part", "pooled"]
# Least standard deviations: log words, log word length, and roots of the shares of symbols, repeated lines and windows.
FLOORS = (0.25, 0.05, 0.05, 0.1, 0.1)
P = len(FLOORS)
# The median and the 1 - 1e-6 quantile of chi-square with five degrees of freedom.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 35.888
BLANK = r"[\x20\x09-\x0D]+"


def counted(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Written once: a later filter on these columns must not be pushed into the array functions they come from.
    """
    rows = pick(docs, "doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id", "lang", "source", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"))
    window = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, window).otherwise(F.array().cast("array<string>")).alias("windows"))
    # Most texts repeat no window: one hash set tells. Else the windows are sorted with their places.
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed))).drop("windows")
    twice = F.filter("sorted", lambda x, k: F.coalesce((F.get("sorted", k - 1)["w"] == x["w"]) | (F.get("sorted", k + 1)["w"] == x["w"]),
                                                      F.get("sorted", k - 1)["w"] == x["w"], F.get("sorted", k + 1)["w"] == x["w"], F.lit(False)))
    rows = rows.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    # A window covers three words, fewer where the next one begins sooner.
    covers = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1), p + 3) - p))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("places")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return kept_once(rows.withColumn("base_failed", failed))


def vector() -> list[Column]:
    """The five statistics in whole thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    stats = [F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.least(F.col("n_dup_lines") * 10 / words, F.lit(1.0))),
             F.sqrt(F.col("n_repeat_words") / words)]
    return [F.round(s * 1000).cast("long").alias(f"x{i}") for i, s in enumerate(stats)]


def grouped(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows with their group: language and source, or the language alone where a source has too few."""
    sizes = rows.groupBy("lang", "source").agg((F.count("*") >= least).alias("large"))
    known = join_small(rows, sizes, ["lang", "source"])
    return known.withColumn("part", F.when(F.col("large"), F.col("source"))).withColumn("pooled", ~F.col("large")).drop("large")


def cholesky(moments: DataFrame, mean: list[Column], cov: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """Columns m0.. (centre), l00.. (lower factor of the scatter with its floor) and logdet."""
    df = moments.select(*keep, *(m.alias(f"m{i}") for i, m in enumerate(mean)),
                        *((c + (F.lit((FLOORS[i] * 1000) ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for (i, j), c in cov.items()))
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    df = df.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))
    return df.drop(*(f"c{i}{j}" for i, j in cov))


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs())]


def from_sums(moments: DataFrame, keep: list[str]) -> DataFrame:
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    return cholesky(moments, mean, {(i, j): F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j] for i, j in pairs()}, keep)


def measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows joined with their estimates and the squared distance d2, by forward substitution."""
    df = join_small(rows, estimates, KEYS, "inner")
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    df = df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)))
    return df.drop(*(f"y{i}" for i in range(P)), *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in pairs()), "logdet")


def concentrated(rows: DataFrame, estimates: DataFrame, share: float = SHARE) -> DataFrame:
    """One step for every group and start: new estimates from the nearest `share` of the rows, whole bins at a time."""
    df = measured(rows, estimates).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) * BINS).cast("int"))
    binned = df.groupBy(*KEYS, "start", "bin").agg(*sums())
    by = "partition by lang, part, pooled, start"
    binned = binned.selectExpr("*", f"coalesce(sum(n) over ({by} order by bin rows between unbounded preceding and 1 preceding), 0L) as ahead",
                               f"sum(n) over ({by}) as whole")
    near = binned.filter(F.col("ahead") < F.col("whole") * share).groupBy(*KEYS, "start").agg(
        *(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in pairs())]))
    return from_sums(near, [*KEYS, "start"])


def starting(rows: DataFrame) -> DataFrame:
    """Start 0: moments of all rows. Start 1: medians and median deviations.

    Statistics are whole numbers in a narrow range, so exact medians keep a bounded table of counts.
    """
    first = from_sums(rows.groupBy(*KEYS).agg(*sums()).withColumn("start", F.lit(0)), [*KEYS, "start"])
    middle = rows.groupBy(*KEYS).agg(*(F.percentile(f"x{i}", 0.5).alias(f"e{i}") for i in range(P)))
    apart = join_small(rows, middle, KEYS, "inner")
    spread = apart.groupBy(*KEYS).agg(*(F.first(f"e{i}").alias(f"e{i}") for i in range(P)),
                                      *(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"e{i}")).cast("long"), 0.5).alias(f"d{i}") for i in range(P)))
    flat = {(i, j): F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0) for i, j in pairs()}
    second = cholesky(spread.withColumn("start", F.lit(1)), [F.col(f"e{i}") for i in range(P)], flat, [*KEYS, "start"])
    return first.unionByName(second)


def robust(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """The estimate of every group: of both starts the one with the smaller determinant."""
    estimates = kept_once(starting(rows))
    for _ in range(steps):
        estimates = kept_once(concentrated(rows, estimates, share))
    best = F.min_by(F.struct(*(c for c in estimates.columns if c not in KEYS)), F.struct("logdet", "start")).alias("best")
    return estimates.groupBy(*KEYS).agg(best).select(*KEYS, "best.*").drop("start")


def judged(docs: DataFrame, least: int = LEAST, cut: float = CHI2_CUT) -> DataFrame:
    """Per input row the counts, base_failed, kept and distance (null where no estimate applies)."""
    rows = counted(docs)
    passed = kept_once(grouped(rows.filter(~F.col("base_failed")).select("*", *vector()), least))
    pools = kept_once(passed.groupBy(*KEYS).agg((F.count("*") >= least).alias("enough")))
    sizes = join_small(passed, pools, KEYS)
    fit = sizes.filter("enough").select(*KEYS, *(f"x{i}" for i in range(P)))
    found = kept_once(robust(kept_once(fit)))
    at = measured(sizes.filter("enough").drop("enough"), found)
    at = kept_once(at.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) * 64).cast("int")))
    # The scale: the median distance, to a 64th of its logarithm; bins are whole numbers in a narrow range.
    scale = at.groupBy(*KEYS).agg(F.exp(F.percentile("bin", 0.5) / 64).alias("middle"))
    # Estimates from the core of a group are too narrow, which the scale mends; floors make them wide, which stays.
    out = join_small(at, scale, KEYS).withColumn("distance", F.col("d2") * F.least(F.lit(1.0), CHI2_MEDIAN / F.col("middle")))
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = out.select(*names, (F.col("distance") <= cut).alias("kept"), "distance")
    none = F.lit(None).cast("double").alias("distance")
    few = sizes.filter("not enough").select(*names, F.lit(True).alias("kept"), none)
    return out.unionByName(few).unionByName(rows.filter("base_failed").select(*names, F.lit(False).alias("kept"), none))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark.read.parquet(f"{folder}/documents.parquet")).drop("lang", "source")
