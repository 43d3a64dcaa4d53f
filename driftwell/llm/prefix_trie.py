"""A trie of conversation prefixes by van Emde Boas recursion.

All sequences of turns are cut at half depth. Equal first halves below one node become one, and the cut prefix is named
by the smallest conversation that has it; the first halves are the upper trie, the second halves, each below its name,
the lower forests. Both are cut again in the same pass, until every piece is a single turn: a node. A trie of depth D
takes log D passes, and each pass handles all pieces of one height, wherever they hang, as one table. What a piece
holds is told by digests of aligned windows (a window's digest comes from those of its halves), so no pass moves more
than one row per piece, and no conversation is ever one row.

Totals go upward in the same order. When the windows of a height are done, the sums of every lower forest are grafted
onto the node they hang from and onto that node's ancestors in its upper trie, whose list is the piece that ends there.

Defined cases: rows without a conv_id are not part of any conversation; turns come by number, null first, ties by the
digest of (role, text); null role and text are empty; a conversation whose rebuilt form has no turn is a member of the
root and ends there; the smallest member names a node; an empty table has no node, not even a root; repeated rows are
turns of their own; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once, pick
from driftwell.operators.ordered import numbered

GROUP = 5  # conversations that share a start
DEPTHS = 9  # a start has 0 to 8 turns
PACK = 12  # bits of a conv_id that may differ within one packed row of ids


def turn_code(role: Column, text: Column) -> Column:
    """40 hexadecimal digits for a turn: 128 bits of the digest of role and text, 32 bits for the bytes of the text."""
    size = F.octet_length(text)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(size.cast("long")), 8, "0"))


def bytes_of(code: Column) -> Column:
    return F.conv(F.substring(code, 33, 8), 16, 10).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn): the turns in order. Texts stay behind; their codes go on."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    coded = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), turn_code(role, text).alias("code"))
    return numbered(coded, ["conv_id"], ["at", "code"], "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("code").alias("turn"))


def rebuilt(turns: DataFrame, group: int = GROUP, depths: int = DEPTHS) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and (conv_id, pos, turn) of the conversations after the shared starts are put in.

    Conversation c starts with the first h = crc32(c) mod `depths` turns of conversation c - c % group, then comes
    what follows its own first h turns.
    """
    sizes = kept_once(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % depths).alias("h"))
    held = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = kept_once(plan.join(held, "base", "left").withColumn("start_n", F.least("h", F.coalesce("base_n", F.lit(0)))))
    starts = turns.filter(F.col("pos") < depths).withColumnRenamed("conv_id", "base")
    first = starts.join(plan.select("conv_id", "base", "h"), "base").filter("pos <= h").select("conv_id", "pos", "turn")
    own = turns.join(plan.select("conv_id", "h", "start_n"), "conv_id").filter("pos > h")
    rest = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("start_n")).alias("pos"), "turn")
    return sizes.select("conv_id"), first.unionByName(rest)


def _turn_windows(sequences: DataFrame) -> DataFrame:
    """(conv_id, at, code, left, right): the windows of one turn, which have no halves."""
    none = F.lit(None).cast("string")
    return kept_once(sequences.select("conv_id", (F.col("pos") - 1).alias("at"), F.col("turn").alias("code"), none.alias("left"), none.alias("right")))


def _windows(single: DataFrame, height: int) -> list[DataFrame]:
    """The windows of 2^t turns and their halves, for each t up to `height`."""
    levels = [single]
    for _ in range(height):
        half = F.when(F.col("at") % 2 == 0, F.col("code"))
        other = F.when(F.col("at") % 2 == 1, F.col("code"))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max(half).alias("left"), F.max(other).alias("right"))
        code = F.sha2(F.concat("left", F.lit("/"), F.coalesce("right", F.lit(""))), 256)
        levels.append(kept_once(pairs.select("conv_id", "at", code.alias("code"), "left", "right")))
    return levels


def _halved(pieces: DataFrame, windows: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of 2^height turns to pieces of half the height, and which became which.

    A piece: top (depth above it), tag (name of the node it hangs from), code, name (its smallest member), n (members)
    and ends (the code of the whole sequence that ends within it, if one does).
    """
    halves = windows.select(F.col("conv_id").alias("w_name"), F.col("at").alias("w_at"), "left", "right")
    met = (F.col("name") == F.col("w_name")) & (F.shiftright("top", height) == F.col("w_at"))
    cut = kept_once(pieces.join(halves, met).select("top", "tag", "name", "n", "ends", "left", "right"))
    upper = kept_once(cut.groupBy("top", "tag", "left").agg(
        F.min("name").alias("name"), F.sum("n").alias("n"), F.max(F.when(F.col("right").isNull(), F.col("ends"))).alias("ends")))
    names = upper.select(F.col("top").alias("u_top"), F.col("tag").alias("u_tag"), F.col("left").alias("u_left"), F.col("name").alias("u_name"))
    same = (F.col("top") == F.col("u_top")) & (F.col("tag") == F.col("u_tag")) & (F.col("left") == F.col("u_left"))
    named = kept_once(cut.join(names, same).select("top", "name", "n", "ends", "right", "u_name"))
    lower = named.filter("right is not null").select(
        (F.col("top") + (1 << height - 1)).alias("top"), F.col("u_name").alias("tag"), F.col("right").alias("code"), "name", "n", "ends")
    links = named.select("top", "name", "u_name", F.col("right").isNotNull().alias("lower"))
    return upper.select("top", "tag", F.col("left").alias("code"), "name", "n", "ends").unionByName(lower), links


def _grafted(totals: DataFrame, inside: DataFrame, height: int) -> DataFrame:
    """Totals that are right within windows of half the height, made right within 2^height turns.

    inside: (top, name, depth, conv_id), the nodes of every piece of half the height.
    """
    half = 1 << height - 1
    roots = totals.filter((F.col("depth") - 1) % (2 * half) == half)
    grafts = roots.groupBy((F.col("depth") - 1 - half).alias("g_top"), F.col("parent_conv_id").alias("g_name")).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    above = inside.join(grafts, (F.col("top") == F.col("g_top")) & (F.col("name") == F.col("g_name")))
    none = F.lit(None).cast("long").alias("parent_conv_id")
    both = totals.unionByName(above.select("depth", "conv_id", none, "n_leaves", "saved"))
    return kept_once(both.groupBy("depth", "conv_id").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ends, ids) to one digest per `ends`; only the state of the hash is held."""
    now, state = None, None

    def told(key: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["ends", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if state is not None:
                    yield told(now)
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield told(now)


def _end_digests(whole: DataFrame) -> DataFrame:
    """(ends, ends_sha256) of (conv_id, ends): SHA-256 of the sorted ids.

    The hash of one list is a chain, so one task follows it; what it reads are packed ids, a row at a time.
    """
    block = F.shiftright("conv_id", PACK).alias("block")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    packed = whole.groupBy("ends", block).agg(ids)
    return packed.repartition("ends").sortWithinPartitions("ends", "block").select("ends", "ids").mapInArrow(
        _hash_lists, "ends string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, sequences: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    and turn (the code of the node's last turn; null at the root).

    conversations: conv_id, each once. sequences: conv_id, pos (1, 2, ... without gaps) and turn (see `turn_code`).
    """
    everyone = kept_once(conversations.select("conv_id"))
    turns = _turn_windows(sequences)
    root = everyone.agg(F.min("conv_id").alias("name"), F.count("*").alias("n")).first()
    depth = turns.agg(F.coalesce(F.max("at") + 1, F.lit(0))).first()[0]
    height = max(0, depth - 1).bit_length()
    levels = _windows(turns, height)
    top = levels[height].select("conv_id", F.col("code").alias("ends"))
    whole = kept_once(everyone.join(top, "conv_id", "left").withColumn("ends", F.coalesce("ends", F.lit(""))))
    pieces = whole.filter("ends != ''").groupBy("ends").agg(F.min("conv_id").alias("name"), F.count("*").alias("n"))
    pieces = kept_once(pieces.select(F.lit(0).cast("long").alias("top"), F.lit(root.name).cast("long").alias("tag"), F.col("ends").alias("code"), "name", "n", "ends"))
    links: dict[int, DataFrame] = {}
    for t in range(height, 0, -1):
        pieces, links[t] = _halved(pieces, levels[t], t)
    single = kept_once(pieces.select((F.col("top") + 1).alias("depth"), F.col("name").alias("conv_id"), F.col("tag").alias("parent_conv_id"),
                                     F.col("n").alias("n_convs"), F.col("code").alias("turn"), "ends"))
    children = single.groupBy((F.col("depth") - 1).alias("c_depth"), F.col("parent_conv_id").alias("c_of")).agg(F.count("*").alias("n_children"))
    of = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_of"))
    nodes = kept_once(single.join(children, of, "left").drop("c_depth", "c_of").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    totals = nodes.select("depth", "conv_id", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * bytes_of(F.col("turn"))).alias("saved"))
    inside = single.select((F.col("depth") - 1).alias("top"), F.col("conv_id").alias("name"), "depth", "conv_id")
    for t in range(1, height + 1):
        totals = _grafted(totals, inside, t)
        if t < height:
            inside = _joined(inside, links[t], t)
    sums = totals.select(F.col("depth").alias("t_depth"), F.col("conv_id").alias("t_of"), "n_leaves", "saved")
    full = nodes.join(sums, (F.col("depth") == F.col("t_depth")) & (F.col("conv_id") == F.col("t_of")))
    long = lambda value: F.lit(value).cast("long")
    below = totals.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    start = below.filter(F.lit(root.n > 0)).select(
        long(0).alias("depth"), long(root.name).alias("conv_id"), long(None).alias("parent_conv_id"), long(root.n).alias("n_convs"),
        F.lit(None).cast("string").alias("turn"), F.lit("").alias("ends"), "n_children", F.coalesce("n_leaves", long(1)).alias("n_leaves"),
        F.coalesce("saved", long(0)).alias("saved"))
    all_nodes = start.unionByName(full.select(*start.columns))
    digests = _end_digests(whole).withColumnRenamed("ends", "e")
    told = all_nodes.join(digests, F.col("ends") == F.col("e"), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "turn")


def _joined(inside: DataFrame, links: DataFrame, height: int) -> DataFrame:
    """The nodes of every piece of 2^height turns, from those of its halves."""
    half = 1 << height - 1
    parts = inside.select(F.col("top").alias("p_top"), F.col("name").alias("p_name"), "depth", "conv_id")
    first = links.select("top", "name", F.col("top").alias("h_top"), F.col("u_name").alias("h_name"))
    second = links.filter("lower").select("top", "name", (F.col("top") + half).alias("h_top"), F.col("name").alias("h_name"))
    met = first.unionByName(second).join(parts, (F.col("h_top") == F.col("p_top")) & (F.col("h_name") == F.col("p_name")))
    return kept_once(met.select("top", "name", "depth", "conv_id"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = kept_once(turns_of(spark.read.parquet(f"{folder}/conversations.parquet")))
    return prefix_trie(*rebuilt(turns)).drop("turn")


SQL = f"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
), crc(c, s, step, v) AS (
  SELECT c, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT c, s, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(s, step // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE step < 8 * length(s))
), turns AS MATERIALIZED (
  SELECT c, code, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) AS pos
  FROM (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes,
               substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS code
        FROM conversations WHERE conv_id IS NOT NULL)
), plan AS MATERIALIZED (
  SELECT c, c - c % {GROUP} AS base, xor(v, 4294967295::BIGINT) % {DEPTHS} AS h,
         least(xor(v, 4294967295::BIGINT) % {DEPTHS}, (SELECT count(*) FROM turns t WHERE t.c = crc.c - crc.c % {GROUP})) AS k
  FROM crc WHERE step = 8 * length(s)
), seq AS (
  SELECT p.c, t.pos, t.code, t.bytes FROM plan p JOIN turns t ON t.c = p.base AND t.pos <= p.h
  UNION ALL
  SELECT p.c, t.pos - p.h + p.k, t.code, t.bytes FROM plan p JOIN turns t ON t.c = p.c AND t.pos > p.h
), prefixes AS MATERIALIZED (
  SELECT c, pos AS d, bytes, md5(string_agg(code, '') OVER (PARTITION BY c ORDER BY pos)) AS k FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM plan
), named AS MATERIALIZED (
  SELECT c, d, bytes, min(c) OVER (PARTITION BY d, k) AS name, d = max(d) OVER (PARTITION BY c) AS last FROM prefixes
), nodes AS MATERIALIZED (
  SELECT d, name, any_value(bytes) AS bytes, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM named GROUP BY d, name
), edges AS MATERIALIZED (
  SELECT n.d, n.name, p.name AS parent FROM nodes n LEFT JOIN named p ON p.c = n.name AND p.d = n.d - 1
), children AS MATERIALIZED (SELECT d - 1 AS d, parent AS name, count(*) AS n FROM edges GROUP BY 1, 2),
below AS (
  SELECT up.d, up.name, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.bytes) AS saved
  FROM nodes n JOIN named up ON up.c = n.name AND up.d <= n.d LEFT JOIN children k ON k.d = n.d AND k.name = n.name
  GROUP BY up.d, up.name
)
SELECT n.name AS conv_id, n.d AS depth, e.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN edges e ON e.d = n.d AND e.name = n.name JOIN below b ON b.d = n.d AND b.name = n.name
LEFT JOIN children k ON k.d = n.d AND k.name = n.name
"""
