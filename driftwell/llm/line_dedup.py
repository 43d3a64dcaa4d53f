"""Line dedup by a sharded minimal perfect hash over the distinct line hashes.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Each document names its
distinct keys by 128-bit hashes, which are counted map-side first. The distinct hashes are dealt to shards of about
KEYS hashes; a shard's task lays a minimal perfect hash over its hashes (levels of bit arrays: a hash whose slot it has
to itself stays there, the others go on to the next level; the rank of its bit is its number) and stores by that number
a fingerprint of 32 bits and a count that ends at what the threshold needs. That is some eight bytes for a line of
any length. Documents probe these arrays; no line is ever joined or shuffled.

The arrays are measured. Within `limit` bytes every task gets them all and documents stay where they were read. Beyond,
the questions go to the arrays: texts are dealt to blocks by a hash of their content, the distinct (block, hash) pairs
meet their shard, and the block gets back the hashes that are frequent. Both ways give the same rows. A hot line is one
question per block, a hot text one block whose documents adaptive execution splits.

Defined cases: a null or empty text is one empty line; every row counts as a document, also rows that repeat or share a
doc_id; keys shorter than `least` code points, empty ones above all, are never dropped; where all lines go, the kept
text is empty; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once, pick, worker_store

THRESHOLD = 10  # documents
LEAST = 1  # code points of a key
KEYS = 1 << 18  # hashes of a shard, on average
SLOTS = 2  # slots per hash on a level
LIMIT = 64 << 20  # bytes of arrays that every task may hold
BLOCK = 1024  # documents of a block, on average
HELD = 1 << 18  # hashes a counting task holds before it hands them on
# Fixed value: what is taken off both ends of a line.
WHITE = b" \t\n\x0b\x0c\r"


def digest_of(line: bytes, least: int) -> bytes | None:
    """128 bits that name a line's key; None for keys that are too short to count."""
    import xxhash

    key = line.strip(WHITE).lower()
    if len(key) < least or (least > 1 and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of digests."""
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _slots(high: np.ndarray, low: np.ndarray, level: int, width: int) -> np.ndarray:
    """Where hashes fall on a level; another level mixes both halves anew."""
    with np.errstate(over="ignore"):
        x = (high + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(width)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n-1 for n distinct hashes: words of bits, level after level, and their widths."""

    def __init__(self, words: np.ndarray, widths: list[int]):
        self.words, self.widths = words, widths
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]) if len(words) else np.zeros(0, np.int64)

    @classmethod
    def over(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        widths, parts = [], []
        while len(high):
            width = -(-SLOTS * len(high) // 64) * 64
            at = _slots(high, low, len(widths), width)
            alone = np.bincount(at, minlength=width) == 1
            widths.append(width)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            high, low = high[~alone[at]], low[~alone[at]]
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.uint64), widths)

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A hash's number; a hash that was not there when the bits were laid gets any number, or -1."""
        out = np.full(len(high), -1, np.int64)
        rest, start = np.arange(len(high)), 0
        for level, width in enumerate(self.widths):
            if not len(rest):
                break
            at = start + _slots(high[rest], low[rest], level, width)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[rest[here]] = self.before[at[here] >> 6] + np.bitwise_count(below)
            rest, start = rest[~here], start + width
        return out


class Shard:
    """The arrays of one shard: perfect hash, fingerprints, counts."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.frombuffer(row["bits"], "<u8"), list(row["widths"]))
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.counts = np.frombuffer(row["counts"], f"<u{max(1, len(row['counts']) // max(1, len(self.prints)))}")

    @staticmethod
    def laid(high: np.ndarray, low: np.ndarray, n: np.ndarray, threshold: int) -> dict:
        hashed = PerfectHash.over(high, low)
        at, kind = hashed.number(high, low), np.min_scalar_type(threshold)
        prints, counts = np.zeros(len(at), "<u4"), np.zeros(len(at), kind.newbyteorder("<"))
        prints[at] = (low >> np.uint64(32)).astype("<u4")
        counts[at] = np.minimum(n, np.iinfo(kind).max)
        return {"bits": hashed.words.tobytes(), "widths": hashed.widths, "prints": prints.tobytes(), "counts": counts.tobytes()}

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents with a hash, as far as the counts reach; 0 for hashes whose fingerprint differs."""
        at = self.hash.number(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == (low[known] >> np.uint64(32)).astype("<u4")
        out = np.zeros(len(at), np.int64)
        out[known] = self.counts[at[known]]
        return out


@dataclass
class LineIndex:
    """rows: shard, bits, widths, prints, counts; written in the shared folder."""

    rows: DataFrame
    shards: int
    bytes: int
    threshold: int
    least: int


def _counting(least: int) -> Callable:
    """Task function: texts to (high, low, n), n documents each, combined over as many documents as HELD allows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            high, low = halves(list(met))
            return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(met.values(), pa.int64())], names=["high", "low", "n"])

        for batch in batches:
            for text in batch.column(0):
                for digest in {digest_of(line, least) for line in text.as_py().split(b"\n")}:
                    if digest is not None:
                        met[digest] = met.get(digest, 0) + 1
                if len(met) >= HELD:
                    yield handed()
                    met.clear()
        if met:
            yield handed()

    return count


def _plain(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))


def _shard(shards: int):
    return F.pmod(F.col("high"), F.lit(shards)).cast("int").alias("shard")


def line_index(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, keys: int = KEYS) -> LineIndex:
    """Arrays over all distinct line keys of the documents. Needs text; doc_id may be anything."""
    found = _plain(docs).select("text").mapInArrow(_counting(least), "high long, low long, n long")
    counted = kept_once(found.groupBy("high", "low").agg(F.sum("n").alias("n")))
    shards = max(1, math.ceil(counted.count() / keys))

    def lay(rows: pa.Table) -> pa.Table:
        high, low, n = (rows[c].to_numpy() for c in ("high", "low", "n"))
        made = Shard.laid(high.view(np.uint64), low.view(np.uint64), n, threshold)
        return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "bits": pa.array([made["bits"]], pa.binary()),
                         "widths": pa.array([made["widths"]], pa.list_(pa.int64())), "prints": pa.array([made["prints"]], pa.binary()),
                         "counts": pa.array([made["counts"]], pa.binary())})

    schema = "shard int, bits binary, widths array<long>, prints binary, counts binary"
    rows = kept_once(counted.select(_shard(shards), "high", "low", "n").groupBy("shard").applyInArrow(lay, schema))
    held = rows.select(F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("prints") + F.octet_length("counts")), F.lit(0))).first()[0]
    return LineIndex(rows, shards, held, threshold, least)


def _without(texts: list[bytes], least: int, frequent: Callable[[list[bytes]], set[bytes]]) -> tuple[list[int], list[int], list[bytes]]:
    """Lines, dropped lines and the kept text of each text; `frequent` says which of many digests go."""
    cut = [text.split(b"\n") for text in texts]
    named = [[digest_of(line, least) for line in lines] for lines in cut]
    gone = frequent(list({d for digests in named for d in digests if d is not None}))
    kept = [b"\n".join(line for line, d in zip(lines, digests, strict=True) if d not in gone) for lines, digests in zip(cut, named, strict=True)]
    return [len(lines) for lines in cut], [sum(d in gone for d in digests) for digests in named], kept


def _rows(ids: pa.Array, result: tuple[list[int], list[int], list[bytes]]) -> pa.RecordBatch:
    n, dropped, kept = result
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())],
                                      names=["doc_id", "n_lines", "n_dropped", "kept"])


_OUT = "n_lines long, n_dropped long, kept binary"


def _by_arrays(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Every task holds all arrays, as they are within the limit."""
    shared, token = docs.sparkSession.sparkContext.broadcast(index.rows.toArrow()), uuid.uuid4().hex
    shards, threshold, least = index.shards, index.threshold, index.least

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("line_dedup")
        if store.get("of") != token:
            store.update(of=token, shards={row["shard"]: Shard(row) for row in shared.value.to_pylist()})

        def frequent(digests: list[bytes]) -> set[bytes]:
            if not digests:
                return set()
            high, low = halves(digests)
            count, at = np.zeros(len(high), np.int64), high.view(np.int64) % shards
            for k in np.unique(at):
                if (arrays := store["shards"].get(int(k))) is not None:
                    count[at == k] = arrays.count(high[at == k], low[at == k])
            return {digests[i] for i in np.flatnonzero(count >= threshold)}

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                yield _rows(part.column(0), _without(part.column(1).to_pylist(), least, frequent))

    return docs.mapInArrow(probe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def _by_blocks(docs: DataFrame, index: LineIndex) -> DataFrame:
    """The arrays stay in their shards; the blocks of documents ask, and get their frequent hashes."""
    threshold, least = index.threshold, index.least
    blocks = max(1, docs.count() // BLOCK)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {(block, digest) for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                     for line in text.split(b"\n") if (digest := digest_of(line, least)) is not None}
            if pairs:
                high, low = halves([digest for _, digest in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([block for block, _ in pairs], pa.int64()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=["block", "high", "low"])

    def answer(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        held = arrays.to_pylist()
        high, low = (asked[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        count = Shard(held[0]).count(high, low) if held and len(high) else np.zeros(len(high), np.int64)
        yes = np.flatnonzero(count >= threshold)
        digests = np.stack([high[yes], low[yes]], axis=1).astype("<u8")
        return pa.table({"block": asked["block"].take(pa.array(yes)), "digest": pa.array([d.tobytes() for d in digests], pa.binary())})

    asked = dealt.select("block", "text").mapInArrow(ask, "block long, high long, low long").distinct()
    asked = asked.select(_shard(index.shards), "block", "high", "low")
    answers = asked.groupBy("shard").cogroup(index.rows.groupBy("shard")).applyInArrow(answer, "block long, digest binary")
    told = answers.groupBy("block").agg(F.collect_list("digest").alias("gone")).withColumnRenamed("block", "at")
    met = dealt.join(told, F.col("block") == F.col("at"), "left").select("doc_id", "text", "block", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            known: dict[int, set[bytes]] = {}
            parts = []
            for i, text in enumerate(texts):
                if at[i] not in known:
                    known[at[i]] = set(batch.column(3)[i].as_py() or ())
                gone = known[at[i]]
                parts.append(_without([text], least, lambda digests, gone=gone: gone.intersection(digests)))
            n, dropped, kept = ([x for part in parts for x in part[k]] for k in range(3))
            yield _rows(batch.column(0), (n, dropped, kept))

    return met.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, limit: int = LIMIT, index: LineIndex | None = None) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped, kept (the text without the lines that `threshold` documents hold).

    With an `index` of other documents, its threshold and key length hold and its counts alone say what goes; a line
    that is not in it passes for one that is with a chance of at most 2^-32.
    """
    index = index or line_index(docs, threshold, least)
    rows = _plain(docs)
    found = _by_arrays(rows, index) if index.bytes <= limit else _by_blocks(rows, index)
    return found.withColumn("kept", F.col("kept").cast("string"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), gone AS (
  SELECT key AS k FROM keys WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT r) >= {THRESHOLD}
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN gone ON key = k GROUP BY r
"""
