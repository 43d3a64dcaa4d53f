"""Hard negatives for stated anchors, by bounds along a spanning tree of the anchors.

Anchors are dealt to trees of some TREE anchors. A tree is a minimum spanning tree over their integer vectors. For a
candidate y, the score of a child anchor lies within (edge length) x |y| of its parent's score, and if the parent was
not scored, of the parent's own bounds. Where that interval overlaps what the child still looks for, the candidate is
scored exactly, which makes the interval a point again; elsewhere it is passed over. A tree is walked depth by depth,
all anchors of a depth against a block of candidates at once.

First pass: rows of the anchor's label whose bound reaches its present worst best. Second pass: rows of other labels
whose interval overlaps the windows of the anchor's positives, each window starting at its present worst best as soon
as it is full. A task hands on at most a few rows per anchor, which are merged by anchor. Candidates stay where they
are read; trees come to them in passes of at most HELD bytes, so many anchors mean many passes, not much memory.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; equal
anchor rows are one anchor, other repeated rows count each; a row's other rows are those of another vec_id; missing
components of a shorter vector are zero, components and scores beyond 64 bits become the nearest 64-bit integer; an
anchor without positives, or a window without rows, gives no row; empty tables give none; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once, pick

EVERY = 50  # anchors are rows whose vec_id is divisible by it
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
SCALE = 256
TREE = 4096  # anchors of a tree, on average
HELD = 64 << 20  # bytes of trees that a pass brings to every task
BLOCK = 512  # candidates that are held against a tree at once
EXACT = 1 << 53  # integers below are exact as doubles
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(batch: pa.RecordBatch, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of the rows that take part; vectors as whole numbers, padded with zeros or cut to `width`."""
    vectors = batch.column(2)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    ends = np.concatenate([[0], np.cumsum(lengths)])
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fit = wrong[ends[1:]] == wrong[ends[:-1]]
    held = np.zeros((len(lengths), int(lengths.max(initial=0))))
    held[np.arange(held.shape[1])[None, :] < lengths[:, None]] = flat
    held = held[fit]
    with np.errstate(over="ignore"):
        held = np.clip(np.floor(held * float(scale)), float(LEAST), float(MOST))
    if width is not None:
        held = held[:, :width] if held.shape[1] >= width else np.pad(held, ((0, 0), (0, width - held.shape[1])))
    return batch.column(0).to_numpy()[fit], batch.column(1).to_numpy()[fit], held


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree: the points in the order they join, each one's parent (a place in that order, -1 for
    the first) and the length of the edge to it, rounded up."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    best, near, place = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1)
    at = 0
    for k in range(n):
        order[k], place[at] = at, k
        parent[k] = place[near[at]] if k else -1
        best[at] = np.inf
        apart = squares + squares[at] - 2 * (points @ points[at])
        closer = (place < 0) & (apart < best)
        best[closer], near[closer] = apart[closer], at
        if k + 1 < n:
            at = int(np.argmin(np.where(place < 0, best, np.inf)))
    edge = np.linalg.norm(points[order] - points[order[np.maximum(parent, 0)]], axis=1) * (1 + 1e-9)
    return order, parent, np.where(parent < 0, 0.0, edge)


class Tree:
    """The anchors of one tree in an order in which parents come first."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.sort_by("place")
        self.number = rows["tree"][0].as_py()
        self.ids, self.labels, self.parent, self.edge = (rows[c].to_numpy() for c in ("vec_id", "label", "parent", "edge"))
        self.vectors = np.zeros((len(self.ids), width))
        for i, vector in enumerate(rows["vector"].to_pylist()):
            self.vectors[i, : len(vector)] = vector
        depth = np.zeros(len(self.ids), np.int64)
        for i in range(1, len(depth)):
            depth[i] = depth[self.parent[i]] + 1
        self.depths = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
        self.largest = float(np.abs(self.vectors).max(initial=0.0))

    def met(self, labels: np.ndarray, vectors: np.ndarray, same: bool, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(anchor, candidate, score) of all pairs of the wanted labels with a score from `least` to `most` of the
        anchor, and how many pairs were scored for it."""
        wanted = (self.labels[:, None] == labels[None, :]) == same
        if 100.0 * vectors.shape[1] * self.largest * float(np.abs(vectors).max(initial=0.0)) >= EXACT:
            a, y = np.nonzero(wanted)
            exact = [sum(int(p) * int(q) for p, q in zip(self.vectors[i], vectors[j], strict=True)) for i, j in zip(a, y, strict=True)]
            score = np.array([min(max(s, LEAST), MOST) for s in exact], np.int64)
            fits = (score >= least[a]) & (score <= most[a])
            return a[fits], y[fits], score[fits], len(a)
        norms = np.linalg.norm(vectors, axis=1) * (1 + 1e-9)
        low, high = np.zeros(wanted.shape), np.zeros(wanted.shape)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scored = 0
        for d, at in enumerate(self.depths):
            if d == 0:
                open_ = np.ones((len(at), len(labels)), bool)
            else:
                reach = self.edge[at][:, None] * norms[None, :]
                low[at], high[at] = low[self.parent[at]] - reach, high[self.parent[at]] + reach
                # Scores are whole numbers, so half a point covers the rounding of the bounds.
                open_ = wanted[at] & (high[at] + 0.5 >= least[at][:, None]) & (low[at] - 0.5 <= most[at][:, None])
            scored += int(open_.sum())
            if open_.mean() > 0.2:
                score = self.vectors[at] @ vectors.T
                low[at] = high[at] = score
                open_ &= wanted[at] & (score >= least[at][:, None]) & (score <= most[at][:, None])
                a, y = np.nonzero(open_)
                out.append((at[a], y, score[a, y]))
            else:
                a, y = np.nonzero(open_)
                a = at[a]
                score = np.einsum("ij,ij->i", self.vectors[a], vectors[y])
                low[a, y] = high[a, y] = score
                fits = (score >= least[a]) & (score <= most[a])
                out.append((a[fits], y[fits], score[fits]))
        a, y, score = (np.concatenate([x[k] for x in out]) for k in range(3))
        return a, y, score.astype(np.int64), scored


class Best:
    """The best few (score descending, id ascending) of each of n slots."""

    def __init__(self, n: int, few: int):
        self.few, self.n = few, n
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.worst = np.full(n, LEAST, np.int64)  # score of the last one of a full slot

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, id_ = (np.concatenate(pair) for pair in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score.astype(object) if (score == LEAST).any() else -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.searchsorted(slot, slot)
        stays = np.arange(len(slot)) - first < self.few
        self.slot, self.score, self.id = slot[stays], score[stays], id_[stays]
        last = np.arange(len(slot)) - first == self.few - 1
        self.worst[slot[last]] = score[last]


def _anchors(rows: DataFrame, every: int, scale: int, size: int) -> tuple[DataFrame, int]:
    """(tree, place, parent, edge, vec_id, label, vector) of all anchors, and the number of trees."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = whole_vectors(batch, scale)
            bare = [np.trim_zeros(v, "b") for v in vectors]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(bare, pa.list_(pa.float64()))], names=["vec_id", "label", "vector"])

    stated = kept_once(rows.filter(F.col("vec_id") % every == 0).mapInArrow(scaled, "vec_id long, label long, vector array<double>").distinct())
    trees = max(1, math.ceil(stated.count() / size))

    def plant(table: pa.Table) -> pa.Table:
        listed = table["vector"].to_pylist()
        points = np.zeros((len(listed), max(map(len, listed))))
        for i, vector in enumerate(listed):
            points[i, : len(vector)] = vector
        order, parent, edge = spanning_tree(points)
        mine = table.take(pa.array(order))
        return pa.table({"tree": mine["tree"], "place": pa.array(np.arange(len(order))), "parent": pa.array(parent), "edge": pa.array(edge),
                         "vec_id": mine["vec_id"], "label": mine["label"], "vector": mine["vector"]})

    dealt = stated.withColumn("tree", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(trees)).cast("int"))
    return kept_once(dealt.groupBy("tree").applyInArrow(plant, "tree int, place long, parent long, edge double, vec_id long, label long, vector array<double>")), trees


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = whole_vectors(batch.slice(start, BLOCK), scale, width)
            if len(block[0]):
                yield block


def _leading(found: DataFrame, keys: list[str], score: str, id_: str, few: int, out: str) -> DataFrame:
    ranked = found.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(id_))))
    return ranked.filter(F.col(out) <= few)


def _nearest(rows: DataFrame, trees: list[Tree], positives: int, scale: int, width: int) -> DataFrame:
    """(tree, place, k, positive_id, positive_score): the first rows of an anchor's own label."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        best = [Best(len(t.ids), positives) for t in trees]
        for ids, labels, vectors in _blocks(batches, scale, width):
            for tree, held in zip(trees, best, strict=True):
                a, y, score, _ = tree.met(labels, vectors, True, held.worst, np.full(len(tree.ids), MOST))
                other = tree.ids[a] != ids[y]
                held.add(a[other], score[other], ids[y[other]])
        for tree, held in zip(trees, best, strict=True):
            if len(held.slot):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held.slot), tree.number), pa.int32()), pa.array(held.slot), pa.array(held.id), pa.array(held.score)],
                                                 names=["tree", "place", "positive_id", "positive_score"])

    found = rows.mapInArrow(task, "tree int, place long, positive_id long, positive_score long")
    return _leading(found, ["tree", "place"], "positive_score", "positive_id", positives, "k")


def windows(found: pa.Table, trees: list[Tree], positives: int, low: int, high: int) -> list[tuple[np.ndarray, ...]]:
    """Per tree: positive's id, its score, first and last score of its window, each (anchors x positives); windows that
    nothing can fit start after their end."""
    out = []
    for tree in trees:
        shape = (len(tree.ids), positives)
        ids, scores, first, last = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.full(shape, MOST), np.full(shape, LEAST)
        mine = found.filter(pc.equal(found["tree"], tree.number))
        for place, k, id_, score in zip(*(mine[c].to_pylist() for c in ("place", "k", "positive_id", "positive_score")), strict=True):
            ids[place, k - 1], scores[place, k - 1] = id_, score
            start, end = -(-low * score // 100), high * score // 100
            if start <= end:
                first[place, k - 1], last[place, k - 1] = max(start, LEAST), min(end, MOST)
        out.append((ids, scores, first, last))
    return out


def _in_windows(rows: DataFrame, trees: list[Tree], spans: list[tuple[np.ndarray, ...]], negatives: int, scale: int, width: int) -> DataFrame:
    """(tree, place, k, anchor_id, positive_id, positive_score, rank, negative_id, negative_score)."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, spans))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, spans = shared.value
        best = [Best(span[0].size, negatives) for span in spans]
        for ids, labels, vectors in _blocks(batches, scale, width):
            for tree, (_, _, first, last), held in zip(trees, spans, best, strict=True):
                start = np.maximum(first, held.worst.reshape(first.shape))
                still = np.where(start <= last, start, MOST)
                a, y, score, _ = tree.met(labels, vectors, False, still.min(axis=1), last.max(axis=1))
                n = first.shape[1]
                for k in range(n):
                    fits = (score >= still[a, k]) & (score <= last[a, k])
                    held.add(a[fits] * n + k, score[fits], ids[y[fits]])
        for tree, (ids, scores, _, _), held in zip(trees, spans, best, strict=True):
            if len(held.slot):
                place, k = np.divmod(held.slot, ids.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), tree.number), pa.int32()), pa.array(place), pa.array(k), pa.array(tree.ids[place]), pa.array(ids[place, k]),
                     pa.array(scores[place, k]), pa.array(held.id), pa.array(held.score)],
                    names=["tree", "place", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = rows.mapInArrow(task, "tree int, place long, k long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _leading(found, ["tree", "place", "k"], "negative_score", "negative_id", negatives, "rank")


def hard_negatives(table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, tree: int = TREE, held: int = HELD) -> DataFrame:
    """For each anchor and each of its first `positives` rows of its own label, the first `negatives` rows of other
    labels that score from `low` to `high` hundredths of the positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    table: vec_id, embedding (list of numbers), label; components become floor(scale * x). Scores are inner products,
    higher ones first, ties by smaller vec_id.
    """
    spark = table.sparkSession
    rows = pick(table, "vec_id", "label", "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    anchors, trees = _anchors(rows, every, scale, tree)
    width = anchors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    per = max(1, held // (8 * max(1, width) * tree))
    parts = []
    for start in range(0, trees, per):
        planted = anchors.filter((F.col("tree") >= start) & (F.col("tree") < start + per)).toArrow()
        of = [Tree(planted.filter(pc.equal(planted["tree"], n)), width) for n in sorted(set(planted["tree"].to_pylist()))]
        if not of:
            continue
        near = _nearest(rows, of, positives, scale, width).select("tree", "place", "k", "positive_id", "positive_score").toArrow()
        part = _in_windows(rows, of, windows(near, of, positives, low, high), negatives, scale, width)
        parts.append(kept_once(part) if trees > per else part)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts).select(*columns)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), anchors AS MATERIALIZED (
  SELECT *, row_number() OVER () AS a FROM (SELECT DISTINCT * FROM v WHERE vec_id % {EVERY} = 0)
), scored AS MATERIALIZED (
  SELECT a, anchors.vec_id AS anchor_id, v.vec_id AS id, v.label = anchors.label AS same, list_inner_product(anchors.e, v.e)::BIGINT AS s
  FROM anchors JOIN v ON v.vec_id != anchors.vec_id
), pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, id) AS k FROM scored WHERE same) WHERE k <= {POSITIVES}
), neg AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.s DESC, n.id) AS rank, n.id AS negative_id,
         p.s AS positive_score, n.s AS negative_score
  FROM pos p JOIN scored n ON n.a = p.a AND NOT n.same AND {LOW} * p.s <= 100 * n.s AND 100 * n.s <= {HIGH} * p.s
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
