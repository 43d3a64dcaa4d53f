"""Language identification by prediction with partial matching over bytes.

Every language gets a context tree of its training texts: how often each byte followed each context of up to three
bytes. A text's code length under a language is the sum over its bytes of -log2 of their probability in the longest
known context; a byte that context never saw pays the escape probability and is coded one context shorter (method C:
escapes weigh as many as there are different successors). The statistics are frozen after training, so every code
length is exact and does not depend on order or partitioning. The language with the shortest code wins.

Texts are lower-cased, and ASCII characters other than letters count as spaces. Counting covers all training rows.
Four-byte nodes below a relative frequency of `floor` are dropped, so a language keeps at most 1/floor of them; shorter
contexts are counted before that and keep all they saw. Any number of languages is learned: a tree holds the nodes its language has and no others, and a text meets them group by
group.

Defined cases: a null or empty text and one without a letter is `und` with score 0; so is every text if no training
row has a language; equal code lengths go to the language that sorts first; a repeated row is counted as often as it
stands there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import batches_by_bytes, free_stores, join_small, kept_once, pick

FLOOR = 1e-5
BLOCK = 1 << 20  # bytes counted or scored at a time
WAITING = 16 * BLOCK  # bytes of all languages that wait to be counted
GROUP = 16  # languages whose code lengths are held at a time
CERTAIN = 64  # bytes after which more text adds no further certainty to the score
UNKNOWN = "und"


def folded() -> bytes:
    """Byte table: ASCII letters in lower case, all other ASCII as space, higher bytes as they are."""
    keep = lambda b: b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32
    return bytes(keep(b) for b in range(256))


def crc_mod(key: Column, n: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _grams(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    return (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def gram_counter(table: bytes):
    """Task function: (lang, text) batches to (lang, gram, n), one row per task for each gram it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_stores()
        held: dict[str, list] = {}
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        total = 0

        def settle(lang: str) -> None:
            # Texts are three spaces apart, so that each begins in the same context.
            grams = np.sort(_grams(np.frombuffer(b"   " + b"   ".join(waiting.pop(lang)), np.uint8)))
            size[lang] = 0
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            held.setdefault(lang, []).append((grams[first], np.diff(np.r_[first, len(grams)])))
            if len(held[lang]) >= 16:
                held[lang] = [_merged(held[lang])]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text.translate(table))
                size[lang] = size.get(lang, 0) + len(text)
                total += len(text)
                if size[lang] >= BLOCK:
                    total -= size[lang]
                    settle(lang)
                if total >= WAITING:
                    total = 0
                    for each in list(waiting):
                        settle(each)
        for lang in list(waiting):
            settle(lang)
        for lang, parts in held.items():
            keys, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
                                             names=["lang", "gram", "n"])

    return count


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, gram (four bytes), n over all rows of (lang, text)."""
    batches_by_bytes(texts.sparkSession)
    lowered = texts.select("lang", F.lower("text").cast("binary").alias("text"))
    counted = lowered.mapInArrow(gram_counter(folded()), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys stand among the sorted ones, and which of them do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """Frozen code lengths of one language: sorted keys of its nodes and contexts, from three bytes of context to one.

    The shorter contexts are taken from three-byte nodes if these are given apart.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shorter: tuple[np.ndarray, np.ndarray] | None = None):
        self.orders = []
        for mask in (0xFFFFFFFF, 0xFFFFFF, 0xFFFF):
            if mask == 0xFFFFFF and shorter is not None:
                grams, counts = shorter
            keys, n = _merged([(grams.astype(np.uint32) & np.uint32(mask), counts.astype(np.int64))]) if len(grams) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            contexts, own, kinds = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
            whole = np.bincount(own, n, len(contexts)) + kinds
            self.orders.append((np.uint32(mask), keys, -np.log2(n / whole[own]), contexts, -np.log2(kinds / whole)))
        n = np.bincount((grams & 255).astype(np.int64), counts, 256)
        kinds = (n > 0).sum()
        whole = max(n.sum() + kinds, 1)
        # Without any context: one of 256 bytes.
        self.single = np.where(n > 0, -np.log2(np.maximum(n, 1e-300) / whole), 8.0 - (np.log2(kinds / whole) if kinds else 0.0))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the three before it."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for mask, keys, bits, contexts, escapes in self.orders:
            left = grams[todo] & mask
            at, hit = _found(keys, left)
            out[todo[hit]] += bits[at[hit]]
            todo, left = todo[~hit], left[~hit]
            at, known = _found(contexts, left >> np.uint32(8))
            out[todo[known]] += escapes[at[known]]
        out[todo] += self.single[grams[todo] & np.uint32(255)]
        return out


class Trees:
    """The trees of all languages, in order."""

    def __init__(self, counts: dict[str, tuple]):
        self.languages = sorted(counts)
        self.trees = [Tree(*counts[lang]) for lang in self.languages]

    def groups(self, texts: list[bytes], group: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
        """First language of a group, code length of every (folded) text under each of the group."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 3) - 3
        grams = _grams(np.frombuffer(b"".join(b"   " + t for t in texts), np.uint8))
        # Every different gram is looked up once. Gram and place in one number sort together.
        packed = np.sort((grams.astype(np.uint64) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64))
        ordered, place = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(grams) else np.zeros(0, bool)
        own = np.full(len(grams) + 1, new.sum(), np.int64)
        own[place] = np.cumsum(new) - 1
        # Each text's three leading spaces are not coded, so between two texts three places are left out.
        spans = np.stack([ends - lengths, ends], axis=1).reshape(-1)
        for at in range(0, len(self.trees), group):
            out = np.zeros((len(texts), min(group, len(self.trees) - at)))
            for k, tree in enumerate(self.trees[at:at + group]):
                cost = np.r_[tree.bits(ordered[new]), 0.0][own]
                out[:, k] = np.where(lengths > 0, np.add.reduceat(cost, spans)[::2], 0.0)
            yield at, out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every (folded) text under every language."""
        return np.concatenate([np.zeros((len(texts), 0)), *(bits for _, bits in self.groups(texts))], axis=1)

    def best(self, texts: list[bytes], group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each text's language, its score, and its bits per byte."""
        length = np.array([max(1, len(t)) for t in texts])
        # Neighbouring bytes are not independent: beyond CERTAIN bytes the mean is what counts.
        share = np.minimum(length, CERTAIN) / length
        chosen, least, odds = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.zeros(len(texts))
        for at, bits in self.groups(texts, group):
            own = bits.min(axis=1)
            chosen = np.where(own < least, at + bits.argmin(axis=1), chosen)
            lower = np.minimum(own, least)
            odds = odds * np.exp2((lower - least) * share) + np.exp2((lower[:, None] - bits) * share[:, None]).sum(axis=1)
            least = lower
        return chosen, 1 / odds, least / length


def learned(training: DataFrame, floor: float = FLOOR) -> Trees:
    """The trees of all languages of (lang, text). Only their nodes come to the driver."""
    counts = gram_counts(training.filter("lang is not null and text is not null"))
    counts = kept_once(counts)
    totals = sorted(counts.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    # From an Arrow table, as a list of rows would pass through Python workers of its own on the executors.
    codes = training.sparkSession.createDataFrame(pa.table(
        [pa.array([r.lang for r in totals], pa.string()), pa.array(range(len(totals)), pa.int32()), pa.array([r.total for r in totals], pa.int64())],
        names=["lang", "code", "total"]))
    coded = join_small(counts, codes, ["lang"], "inner")

    def by_language(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        table = rows.select("code", "gram", "n").toArrow()
        code, grams, n = (table.column(c).to_numpy() for c in ("code", "gram", "n"))
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(totals) + 1))
        return [(grams[order[a:b]], n[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    long = by_language(coded.filter(F.col("n") >= floor * F.col("total")))
    short = by_language(coded.groupBy("code", F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")))
    return Trees({r.lang: (*a, b) for r, a, b in zip(totals, long, short, strict=True)})


def verdict(spark: SparkSession, text: Column, trees: Trees) -> Column:
    """struct(lang, score, bits) of a text; bits is per byte of the folded text. Only the text goes through Python."""
    batches_by_bytes(spark)
    shared, table = spark.sparkContext.broadcast(trees), folded()

    @F.arrow_udf("lang string, score double, bits double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_stores()
        trees = shared.value
        for batch in batches:
            texts = [t.translate(table) if t is not None else None for t in batch.to_pylist()]
            best, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            todo = [i for i, t in enumerate(texts) if t is not None] if trees.languages else []
            while todo:
                now, size = [], 0
                while todo and (not now or size + len(texts[todo[-1]]) <= BLOCK):
                    now.append(todo.pop())
                    size += len(texts[now[-1]])
                chosen, odds, bits = trees.best([texts[i] for i in now])
                for j, i in enumerate(now):
                    best[i], score[i], rate[i] = trees.languages[chosen[j]], odds[j], bits[j]
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score), pa.array(rate)], names=["lang", "score", "bits"])

    return judge(F.when(text.rlike(r"\p{L}"), F.lower(text).cast("binary")))


def identified(docs: DataFrame, trees: Trees) -> DataFrame:
    """Per input row: doc_id, lang_pred, score, bits."""
    texts = pick(docs, "doc_id", "text")
    found = texts.select("doc_id", verdict(docs.sparkSession, F.col("text"), trees).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), "found.score", "found.bits")


def trained_on(docs: DataFrame) -> Trees:
    """Learned from rows with a language whose crc32(doc_id) mod 4 is not 2."""
    rows = pick(docs, "doc_id", "lang", "text").filter(crc_mod(F.col("doc_id"), 4) != 2)
    return learned(rows.select("lang", "text"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = identified(docs, trained_on(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language it knows go on: `und` goes, and so does a text that even its best language codes in
    more than the eight bits a byte has anyway.

    Only the text goes through Python; the other columns wait in the JVM, and nothing is shuffled.
    """
    found = docs.withColumn("__found", verdict(spark, F.col("text"), trained_on(docs)))
    return found.filter(f"__found.lang != '{UNKNOWN}' and __found.bits <= 8").select(*docs.columns)
