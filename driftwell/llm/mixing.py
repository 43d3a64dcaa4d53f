"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words to reach. Within a source a document's expected copies grow with the bit length
of its size, up to a ceiling; the whole part of that number is taken for certain, and the fraction is its inclusion
probability in a fixed-size sample: documents are ranked by random odds over inclusion odds, and the ranking is cut
where the words taken come nearest to what the certain copies left open.

The cut never orders a whole source. Ranks are first counted in fine bins, which finds the one bin with the cut in
it; only that bin is ordered.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
last in order; the random number depends on doc_id and the seed alone, so reruns agree and equal rows share it (ties
are ordered by size, and equal rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import WORD, join_small, kept_once, pick, uniform, uniform_sql

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words, to be mixed
CEILING = 2  # times a source's or a document's size
SEED = 7
ROWS_PER_BIN = 4096  # expected rows of the bin that is ordered


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row, written once as the texts are long."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return kept_once(pick(docs, "doc_id", "source", "text").select("doc_id", "source", words.alias("size")))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, ceiling: float) -> DataFrame:
    """source, source_size, target: shares by weight, what lies above the ceiling reshared among the rest.

    Sources reach their ceiling in the order of ceiling over weight, so the final level follows from running sums in
    that order. One row per source goes through these windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = ", ".join(str(w) for w in weights)
    order = "order by source_size / weight, source nulls last"
    return totals.selectExpr(
        "source", "source_size", f"{ceiling}D * source_size as most", f"{share}D * sum(source_size) over () as whole",
        f"cast(element_at(array({listed}), cast((row_number() over (order by source nulls last) - 1) % {len(weights)} as int) + 1) as double) as weight",
    ).selectExpr(
        "*", f"coalesce(sum(most) over ({order} rows between unbounded preceding and 1 preceding), 0D) as full",
        f"sum(weight) over ({order} rows between current row and unbounded following) as open",
    ).selectExpr(
        "*", "min(case when (whole - full) / open * weight <= most then struct(full, open) end) over () as level",
    ).selectExpr(
        "source", "source_size", "coalesce(least(most, (whole - level.full) / level.open * weight), most) as target",
    )


def copies_per_class(sizes: DataFrame, aims: DataFrame, ceiling: float) -> DataFrame:
    """source, class, expected: copies expected of a document whose size has that many bits.

    expected = min(ceiling, level x bits), with the level at which the source's words meet its target. There are at
    most 64 classes per source.
    """
    per_class = sizes.groupBy("source", "class").agg(F.sum("size").alias("words"))
    both = join_small(per_class, aims.select("source", "target"), ["source"], "inner")
    order = "partition by source order by class desc"
    return both.selectExpr(
        "*", f"coalesce(sum(words) over ({order} rows between unbounded preceding and 1 preceding), 0L) as above",
        f"sum(class * words) over ({order} rows between current row and unbounded following) as weighed",
    ).selectExpr(
        "*", f"case when weighed > 0 and (target - {ceiling}D * above) / weighed * class <= {ceiling}D "
             f"then (target - {ceiling}D * above) / weighed end as fits",
    ).selectExpr(
        "source", "class", "max_by(fits, case when fits is not null then class end) over (partition by source) as level",
    ).selectExpr("source", "class", f"coalesce(greatest(0D, least({ceiling}D, level * class)), {ceiling}D) as expected")


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1.0 - u)) * ((1.0 - p) / p)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING,
          seed: int = SEED, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, copies, taken."""
    sizes = sized(docs).withColumn("class", F.length(F.bin("size")))
    aims = kept_once(targets(sizes, weights, share, ceiling))
    wanted = join_small(sizes, copies_per_class(sizes, aims, ceiling), ["source", "class"])
    wanted = wanted.withColumn("certain", F.floor("expected"))
    wanted = wanted.withColumn("p", F.when(F.col("size") > 0, F.col("expected") - F.col("certain")).otherwise(0.0))
    rank = F.when(F.col("p") > 0, pareto_rank(uniform(F.col("doc_id"), seed), F.col("p")))
    ranked = kept_once(wanted.withColumn("rank", rank).drop("class", "expected"))

    bins = max(1024, ranked.count() // rows_per_bin)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * bins).cast("long"))
    per_source = ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    per_source = join_small(per_source, aims, ["source"], "inner")
    per_source = kept_once(per_source.withColumn("open", F.col("target") - F.col("sure")))
    per_bin = ranked.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    ahead = "coalesce(sum(words) over (partition by source order by bin rows between unbounded preceding and 1 preceding), 0L)"
    per_bin = join_small(per_bin.selectExpr("*", f"{ahead} as ahead"), per_source.select("source", "open"), ["source"], "inner")
    # The bin with the cut: what lies before it is less than what is open, what it ends with is more.
    cut = per_bin.filter("ahead < open and ahead + words > open").select("source", F.col("bin").alias("cut"), "ahead")
    full = per_bin.filter("ahead + words <= open").groupBy("source").agg(F.max("bin").alias("full"))
    facts = join_small(join_small(per_source.drop("sure", "open"), full, ["source"]), cut, ["source"])
    facts = join_small(facts, per_source.select("source", "open"), ["source"])

    known = join_small(ranked, facts, ["source"])
    inside = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    running = "coalesce(sum(size) over (partition by source order by rank, doc_id, size rows between unbounded preceding and 1 preceding), 0L)"
    at_cut = known.filter(inside).selectExpr("*", f"2 * (ahead + {running}) + size <= 2 * open as drawn")
    clear = known.filter(~inside).selectExpr("*", "coalesce(bin <= full, false) as drawn")
    out = clear.unionByName(at_cut).withColumn("copies", F.col("certain") + F.col("drawn").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), classed AS (SELECT *, length(bin(size)) AS class FROM sizes),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, 2.0e0 * source_size AS most, 1.5e0 * sum(source_size) OVER () AS whole,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM totals
), levels AS (
  SELECT *, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS fulls,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opens
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), aims AS (
  SELECT source, source_size, coalesce(least(most, (whole - f) / o * weight), most) AS target
  FROM levels LEFT JOIN (SELECT fulls AS f, opens AS o FROM levels WHERE (whole - fulls) / opens * weight <= most
                         ORDER BY fulls, opens LIMIT 1) ON true
), per_class AS (
  SELECT source, class, target, words, coalesce(sum(words) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(class * words) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w
  FROM (SELECT source, class, target, sum(size)::BIGINT AS words FROM classed
        JOIN aims USING (source) GROUP BY ALL
        UNION ALL SELECT c.source, class, target, sum(size)::BIGINT FROM classed c
        JOIN aims a ON c.source IS NULL AND a.source IS NULL GROUP BY ALL) g
  WINDOW c AS (PARTITION BY source ORDER BY class DESC)
), expected AS (
  SELECT source, class, target, coalesce(greatest(0.0e0, least(2.0e0, max_by(fits, CASE WHEN fits IS NOT NULL THEN class END)
         OVER (PARTITION BY source) * class)), 2.0e0) AS m
  FROM (SELECT *, CASE WHEN w > 0 AND (target - 2.0e0 * above) / w * class <= 2.0e0 THEN (target - 2.0e0 * above) / w END AS fits
        FROM per_class)
), chances AS (
  SELECT c.doc_id, c.source, c.size, e.target, floor(m)::BIGINT AS certain, CASE WHEN size > 0 THEN m - floor(m) ELSE 0.0e0 END AS p,
         {uniform_sql('doc_id', SEED)} AS u
  FROM classed c JOIN expected e ON c.source IS NOT DISTINCT FROM e.source AND c.class = e.class
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0e0 - u)) * ((1.0e0 - p) / p) END AS r,
         target - sum(certain * size) OVER (PARTITION BY source) AS open FROM chances
), taken AS (
  SELECT *, certain + CASE WHEN r IS NOT NULL AND 2 * coalesce(sum(CASE WHEN r IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source
         ORDER BY r NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= 2 * open
         THEN 1 ELSE 0 END AS copies FROM ranked
)
SELECT doc_id, size, a.source_size, a.target, (copies * size)::BIGINT AS taken
FROM taken t JOIN aims a ON t.source IS NOT DISTINCT FROM a.source
"""


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as many times as the mix takes it, all columns kept.

    Copies are found by doc_id; rows that share a doc_id and a size have the same chance, and each gets the copies of
    one of them.
    """
    drawn = kept_once(mixed(docs).select("doc_id", "source", "size", "copies"))
    order = "partition by doc_id, source, size"
    drawn = drawn.selectExpr("doc_id as __id", "source as __source", "size as __size", "copies as __copies",
                             f"row_number() over ({order} order by copies desc) as __nth")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.withColumn("__words", size)
    if drawn.filter("__nth > 1").isEmpty():
        nth = F.lit(1)
    else:
        nth = F.expr("row_number() over (partition by doc_id, source, __words order by text)")
    rows = rows.withColumn("__row", nth)
    same = (rows["doc_id"].eqNullSafe(drawn["__id"]) & rows["source"].eqNullSafe(drawn["__source"])
            & (rows["__words"] == drawn["__size"]) & (rows["__row"] == drawn["__nth"]))
    met = rows.join(drawn.filter("__copies > 0"), same)
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
