"""SimHash near duplicates by pivot distance tables.

A text's fingerprint has a bit for every position that more than half of its shingle hashes set. Two fingerprints
link if they differ in at most RADIUS bits. For every distinct fingerprint the Hamming distances to many reference
fingerprints (pivots) are precomputed. By the triangle inequality the coordinates of two linked fingerprints differ by
at most RADIUS, so a pair with a larger difference anywhere is discarded; what survives is verified.

To meet without comparing all pairs, the pivots are laid out in four quarters: a pivot has random bits in its own
quarter and none elsewhere, so its distance minus the distance to the zero pivot only depends on that quarter. Two
bits touch at most two quarters, so linked fingerprints agree in all coordinates of some two quarters: those two
coordinate groups are the bucket key, six keys in all. Buckets above RUN rows are dealt again by thirds of the bits the
key leaves open, one of which agrees too; what remains of such a bucket differs in less than half of the bits.

A bucket hands on a spanning forest of its links, not its pairs. Components of those links are the classes.

Defined cases: a null text counts as empty; a text without words has fingerprint zero, linked like any other; with
fewer than three words the whole sequence is its only shingle; equal fingerprints are one class; a null doc_id never
names a component unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import batches_by_bytes, free_stores, kept_once, pick
from driftwell.llm.components import components

RADIUS = 2
PER_QUARTER = 8  # pivots
SIZE = 3  # words of a shingle
RUN = 1024  # fingerprints of a bucket that are compared as they are
XXH_SEED = 42
PIVOT_SEED = 20


def fingerprints_of(texts: list[bytes], size: int = SIZE) -> np.ndarray:
    """64 bits for each text: A-Z in lower case, words, shingles with repeats, XXH64, majority of every bit."""
    import xxhash

    digest, seed = xxhash.xxh64_intdigest, XXH_SEED
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < size:
            out[i] = digest(b" ".join(words), seed)
            continue
        spans = zip(*(words[k:] for k in range(size)), strict=False)
        hashes = np.fromiter([digest(b" ".join(s), seed) for s in spans], np.uint64, len(words) - size + 1)
        bits = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
            bits += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_stores()
        for batch in batches:
            yield pa.array(fingerprints_of(batch.to_pylist(), size).view(np.int64))

    return compute(F.coalesce(text, F.lit("")).cast("binary"))


def pivots(per_quarter: int = PER_QUARTER, seed: int = PIVOT_SEED) -> np.ndarray:
    """Reference fingerprints: zero, then for each quarter random patterns of its sixteen bits."""
    rng = np.random.default_rng(seed)
    own = rng.integers(1, 1 << 16, (4, per_quarter)).astype(np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), *(own[q] << np.uint64(16 * q) for q in range(4))])


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def bucket_task(per_quarter: int):
    """Task function: fingerprints to (key, print, table), six rows each; the table goes along as bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(per_quarter)
        pairs = list(combinations(range(4), 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                prints = batch.column(0).slice(at, 1 << 15).to_numpy(zero_copy_only=False).view(np.uint64)
                table = pivot_table(prints, refs)
                relative = (table[:, 1:] - table[:, :1]).reshape(len(prints), 4, per_quarter)
                rows = [r.tobytes() for r in np.ascontiguousarray(table)]
                keys = []
                for which, (a, b) in enumerate(pairs):
                    part = np.ascontiguousarray(np.concatenate([np.full((len(prints), 1), which, np.int8), relative[:, a], relative[:, b]], axis=1))
                    keys += [k.tobytes() for k in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(np.tile(prints.view(np.int64), len(pairs))), pa.array(rows * len(pairs), pa.binary())],
                    names=["key", "print", "table"])

    return deal


def forest(prints: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what a bucket's links connect, at most one fewer than its fingerprints.

    Every fingerprint is held against those before it, a row at a time: coordinates first, then the bits.
    """
    label = np.arange(len(prints))
    left, right = [], []
    for i in range(1, len(prints)):
        near = np.arange(i)
        for column in range(0, table.shape[1], 4):  # the first coordinates discard most
            if not len(near):
                break
            near = near[(np.abs(table[near, column:column + 4] - table[i, column:column + 4]) <= radius).all(axis=1)]
        near = near[np.bitwise_count(prints[near] ^ prints[i]) <= radius]
        if len(near):
            classes, first = np.unique(label[near], return_index=True)
            left += [i] * len(first)
            right += near[first].tolist()
            least = classes[0]
            label[i] = least
            for c in classes[1:]:
                label[label == c] = least
    return left, right


def link_task(radius: int):
    """Task function over rows sorted by key: links of every bucket. Only one bucket is held at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []

        def settle() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            prints = np.array([r[1] for r in held], np.int64)
            table = np.frombuffer(b"".join(r[2] for r in held), np.int8).reshape(len(held), -1)
            left, right = forest(prints.view(np.uint64), table, radius)
            return pa.RecordBatch.from_arrays([pa.array(prints[left]), pa.array(prints[right])], names=["a", "b"]) if left else None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    if (found := settle()) is not None:
                        yield found
                    held = []
                held.append(row)
        if (found := settle()) is not None:
            yield found

    return scan


def third_task():
    """Task function: rows of large buckets to three rows each, their key made longer by a third of the open bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = list(combinations(range(4), 2))
        for batch in batches:
            keys, prints, tables = (c.to_pylist() for c in batch.columns)
            longer = []
            for key, value in zip(keys, prints, strict=True):
                a, b = (q for q in range(4) if q not in pairs[key[0]])
                free = ((value >> (16 * a)) & 0xFFFF) | (((value >> (16 * b)) & 0xFFFF) << 16)
                longer.append([key + bytes([k]) + ((free >> (11 * k)) & 0x7FF).to_bytes(2, "little") for k in range(3)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for ks in longer for k in ks], pa.binary()), pa.array([p for p in prints for _ in range(3)], pa.int64()),
                 pa.array([t for t in tables for _ in range(3)], pa.binary())], names=["key", "print", "table"])

    return deal


def links(prints: DataFrame, radius: int = RADIUS, per_quarter: int = PER_QUARTER, run: int = RUN) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of column `print` that lie within the radius.

    Exact for a radius of up to two, as two flipped bits leave two quarters, and a third of the rest, untouched.
    """
    if radius > 2:
        raise ValueError("four quarters find links of at most two bits")
    shape = "key binary, print long, table binary"
    dealt = prints.select("print").distinct().mapInArrow(bucket_task(per_quarter), shape)
    large = kept_once(dealt.groupBy("key").count().filter(F.col("count") > run).select(F.col("key").alias("large")))
    if not large.isEmpty():
        small = dealt.join(large, F.col("key") == F.col("large"), "left_anti")
        rest = dealt.join(large, F.col("key") == F.col("large"), "left_semi")
        dealt = small.unionByName(rest.mapInArrow(third_task(), shape))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "print")
    return kept_once(dealt.mapInArrow(link_task(radius), "a long, b long").distinct())


def near_groups(docs: DataFrame, radius: int = RADIUS, size: int = SIZE) -> DataFrame:
    """Per input row: doc_id, print (signed long), component_id (smallest doc_id of the class)."""
    batches_by_bytes(docs.sparkSession)
    rows = kept_once(pick(docs, "doc_id", "text").select("doc_id", fingerprint(F.col("text"), size).alias("print")))
    classes = components(links(rows, radius), "a", "b").toDF("node", "root")
    own = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    placed = own.join(classes, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    names = placed.select(F.col("print").alias("p"), F.col("root").alias("r")).join(named, F.col("r") == F.col("root"))
    return rows.join(names.select("p", "component_id"), F.col("print") == F.col("p")).select("doc_id", "print", "component_id")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of every near-duplicate class the row with its smallest doc_id stays; of several equal ones, one.

    Rows are met by doc_id, and where a doc_id occurs more than once, by its fingerprint as well.
    """
    rows = kept_once(near_groups(docs))
    keep = rows.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct()
    repeated = kept_once(rows.groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1").select("__id"))
    if repeated.isEmpty():
        return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"])).select(*docs.columns)
    known = docs["doc_id"].eqNullSafe(repeated["__id"])
    single, several = docs.join(repeated, known, "left_anti"), docs.join(repeated, known, "left_semi")
    single = single.join(keep, single["doc_id"].eqNullSafe(keep["__id"])).select(*docs.columns)
    several = several.withColumn("__own", fingerprint(F.col("text"))).join(
        keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print")))
    return single.unionByName(several.dropDuplicates(["__id", "__print"]).select(*docs.columns))
