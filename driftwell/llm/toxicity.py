"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text (ASCII punctuation removed, lower case), their stems (the first four and five bytes,
so that inflected forms share evidence), pairs of neighbours, and pairs with one word between them, hashed into a fixed
number of slots; each slot counts once per text. FTRL-proximal gives every slot its
own learning rate and its L1 term leaves most slots at zero, so the model is a short list of weights. It is fitted on
a bounded sample of the labelled rows (`SAMPLE` rows, chosen by a hash of doc_id) and broadcast to score all rows.

Defined cases: a null or empty text has no features and scores the bias alone; without labelled rows every score lies
just below 0.5, so nothing is predicted toxic; several labels of one document all count; a label without a document,
a null label and labels other than 0 and 1 are ignored; a repeated document is scored and learned as often as it is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import kept_once, pick
from driftwell.llm.language import crc_mod

SLOTS = 20  # bits of a slot number; bounds the model at 2^20 weights
SAMPLE = 12_000  # labelled rows fitted on, at most about so many
EPOCHS = 4
STEMS = (4, 5)  # bytes
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
SEED = 10


def plain() -> bytes:
    """Byte table: ASCII letters in lower case, digits, and higher bytes stay; the rest becomes a space."""
    keep = lambda b: b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32
    return bytes(keep(b) for b in range(256))


def slots(text: bytes, table: bytes, bits: int = SLOTS) -> np.ndarray:
    """The distinct slots of a text's words, stems, word pairs and skip pairs."""
    words = text.translate(table).split()
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    stems = [np.fromiter({zlib.crc32(w[:n]) for w in words if len(w) > n}, np.uint32) + np.uint32(2 + n) for n in STEMS]
    left, right = one * np.uint32(0x9E3779B1), one * np.uint32(0x85EBCA77)
    pairs = (left[:-1] ^ right[1:]) + np.uint32(1)
    skips = (left[:-2] ^ right[2:]) + np.uint32(2)
    mixed = np.concatenate([one, pairs, skips, *stems]) * np.uint32(0xC2B2AE3D)
    return np.unique((mixed >> np.uint32(32 - bits)).astype(np.int32))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)
        shrunk = (z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -shrunk)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def feature_task(table: bytes, bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [slots(t, table, bits).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["place", "label", "slots"])

    return extract


def fit_task(bits: int, epochs: int):
    """Task function over the whole, bounded sample in its fixed order: the weights that are not zero."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(s, np.int32), y) for b in batches for s, y in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if not rows:
            return
        model = Ftrl(1 << bits)
        for _ in range(epochs):
            for at, label in rows:
                model.learn(at, label)
        w = model.weights(np.arange((1 << bits) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["slot", "weight"])

    return fit


def labelled(docs: DataFrame, labels: DataFrame, sample: int, seed: int = SEED) -> DataFrame:
    """place, label, text of the sample: rows whose hash is below the share that gives `sample` rows."""
    known = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(crc_mod(F.col("doc_id"), 5) != 0)
    known = known.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))).alias("place"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = kept_once(known.filter(F.col("place") < F.lit(f"{int(share * (1 << 52)):013x}" if share < 1 else "g")))
    # At most about `sample` rows of a few bytes each: the bound is the parameter.
    texts = pick(docs, "doc_id", "text").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("place", "label", "text")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = SLOTS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the model; the bias is slot 2^bits."""
    features = labelled(docs, labels, sample).mapInArrow(feature_task(plain(), bits), "place string, label int, slots binary")
    ordered = features.repartition(1).sortWithinPartitions("place", "label", "slots")
    model = ordered.mapInArrow(fit_task(bits, epochs), "slot long, weight double").toArrow()
    return model.column("slot").to_numpy(), model.column("weight").to_numpy()


def toxic_score(spark: SparkSession, text: Column, model: tuple[np.ndarray, np.ndarray], bits: int = SLOTS) -> Column:
    shared, table = spark.sparkContext.broadcast(model), plain()

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weight = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = weight
        bias = dense[-1] if len(at) else -1e-9
        for batch in batches:
            sums = [bias + dense[slots(t, table, bits)].sum() for t in batch.to_pylist()]
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(sums, dtype=float), -35, 35))), pa.float64())

    return score(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = SLOTS) -> DataFrame:
    """Per input row: doc_id, score, predicted."""
    texts = pick(docs, "doc_id", "text")
    out = texts.select("doc_id", toxic_score(docs.sparkSession, F.col("text"), model, bits).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
