"""Exact duplicates by content-defined chunk recipes.

Texts are cut where their own content says so (after a line or sentence end, within size limits), so equal texts
have equal cuts. Every distinct chunk travels through one shuffle and gets an identifier that is verified: a 64-bit
hash held by a single chunk content, or the hash and the content's rank where contents clash. From then on only the
ordered identifier list of a document, its recipe, is grouped and compared; the text itself does not move again.

Defined cases: a null text counts as empty; an empty text has an empty recipe, so all empty texts are one group; a
null doc_id sorts below every other; of rows that agree in text and in the largest doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import join_small, kept_once, pick

LEAST, MOST = 256, 4096  # characters of a chunk


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in pieces that together give it again. Text that is not valid UTF-8 stays in one piece."""
    cut = rf"(?s).{{{least},{most - 1}}}?[\n.!?]|.{{1,{most}}}"
    whole = F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.is_valid_utf8(text), F.regexp_extract_all(text, F.lit(cut), F.lit(0))).otherwise(whole)


def default_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def clashing_chunks(docs: DataFrame, hashed=default_hash) -> DataFrame | None:
    """(hash, chunk, rank) of all chunk contents that share their hash with another content; None if there are none.

    Distinct contents are found with map-side combining, so a passage that millions of documents repeat is sent once
    per task.
    """
    pieces = docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = pieces.select(hashed(F.col("chunk")).alias("hash"), "chunk").distinct()
    shared = kept_once(distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    if shared.isEmpty():
        return None
    contents = join_small(distinct, shared.withColumn("shared", F.lit(True)), ["hash"], "inner").select("hash", "chunk")
    rank = F.expr("row_number() over (partition by hash order by chunk) - 1").alias("rank")
    return kept_once(contents.select("hash", "chunk", rank))


def recipes(docs: DataFrame, hashed=default_hash) -> DataFrame:
    """One row per input row: row, doc_id, recipe (hash list), ranks (position and rank where a hash is shared)."""
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    clashes = clashing_chunks(docs, hashed)
    cut = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("pieces"))
    if clashes is None:
        plain = cut.select("doc_id", "text_sha256", F.transform("pieces", hashed).alias("recipe"),
                           F.expr("cast(null as array<struct<pos:int,rank:int>>)").alias("ranks"))
        return kept_once(plain.withColumn("row", F.monotonically_increasing_id()))
    numbered = kept_once(cut.withColumn("row", F.monotonically_increasing_id()))
    parts = numbered.select("row", F.posexplode("pieces").alias("pos", "chunk"))
    parts = parts.withColumn("hash", hashed(F.col("chunk")))
    met = join_small(parts, clashes, ["hash", "chunk"], "inner").filter("rank > 0")
    ranks = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    plain = numbered.select("row", "doc_id", "text_sha256", F.transform("pieces", hashed).alias("recipe"))
    return kept_once(plain.join(ranks, "row", "left"))


def exact_groups(docs: DataFrame, hashed=default_hash) -> DataFrame:
    """Per input row: row, doc_id, keep_id, group_size, kept, text_sha256. Needs doc_id and text; other columns are ignored."""
    rows = recipes(docs, hashed)
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
    groups = rows.groupBy("recipe", "ranks").agg(best, F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("g_recipe"), F.col("ranks").alias("g_ranks"),
                           F.col("best.doc_id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "group_size")
    same = (rows["recipe"] == groups["g_recipe"]) & rows["ranks"].eqNullSafe(groups["g_ranks"])
    return rows.join(groups, same).select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return exact_groups(docs).drop("row")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts only the row with the largest doc_id goes on, with all its columns.

    Rows are met by doc_id and text digest. Where several equal rows carry the kept doc_id, one of them is taken.
    """
    groups = exact_groups(docs)
    tied = F.count_if(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("tied")
    keep = groups.filter("doc_id <=> keep_id").groupBy("keep_id", "text_sha256").agg(tied)
    keep = keep.toDF("__id", "__digest", "__tied")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    met = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]) & (digest == keep["__digest"]))
    if keep.filter("__tied > 1").isEmpty():
        return met.select(*docs.columns)
    single = met.filter("__tied = 1").select(*docs.columns)
    several = met.filter("__tied > 1").dropDuplicates(["__id", "__digest"]).select(*docs.columns)
    return single.unionByName(several)
