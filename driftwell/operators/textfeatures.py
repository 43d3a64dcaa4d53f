"""Tf-idf over word uni- and bigrams.

Most bigrams of a corpus occur once or twice, so counting all of them as text moves nearly the corpus. Instead every
term first adds its occurrences to one of a fixed number of cells, by hash. No term is more frequent than its cell, so
only terms of the fullest cells are counted as text; what these counts leave undecided is counted in a second round.

Texts become words in Arrow batches, and words become numbers by a dictionary per piece of a batch; hashes only choose
what is counted, never what is equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.text import GONE, SEVERAL, word_table
from driftwell.operators.ordered import spread
from driftwell.session import ensure_checkpoints

MAX_VOCABULARY = 5000
CELLS = 1 << 20
BLOCK = 1 << 14  # cells that travel together
CHARS = 1 << 21  # characters of text that are cut into words together
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def terms(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """The documents as their terms are read from them: id, text. Null text counts as empty, bytes that are no UTF-8 as
    separators."""
    valid = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    return spread(docs.select(id_column, text), id_column).select(id_column, valid.alias("text"))


def _words(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of the texts in order: number of the text, number of the word in the dictionary; and the dictionary.

    Words are lower-case, without accents, of two or more letters, digits or underscores.
    """
    chars = table[np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")]
    if (chars == SEVERAL).any():
        texts = [t if t.isascii() else unicodedata.normalize("NFKD", t) for t in texts]
        chars = table[np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")]
    ends = np.cumsum([len(t) + 1 for t in texts])
    stays = np.flatnonzero(chars != GONE)
    chars = chars[stays]
    inside = chars > SEVERAL
    edges = np.diff(np.r_[False, inside, False].view(np.int8))
    first, length = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)
    inside[first[length == 1]] = False
    first, length = first[length > 1], length[length > 1]
    letters = chars[inside]
    data = letters.tobytes().decode("utf-32-le").encode()
    offsets = np.r_[0, np.cumsum(length)]
    if len(data) != len(letters):
        begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        offsets = np.r_[begins, len(data)][offsets]
    cut = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    coded = cut.dictionary_encode()
    return np.searchsorted(ends, stays[first], "right"), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pieces(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
    """First row, number of rows and words of consecutive pieces of a batch; texts are not divided."""
    texts, at = batch.column(batch.num_columns - 1).to_pylist(), 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) < CHARS):
            held += len(texts[upto]) + 1
            upto += 1
        yield at, upto - at, _words(texts[at:upto], table)
        at = upto


def _cells(words: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and hash of every word of a dictionary."""
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    return (hashes % np.uint64(cells)).astype(np.int64), hashes


def _pair_cells(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    mixed = (hashes[a] * ODD[0] + hashes[b]) * ODD[1]
    return ((mixed >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)


def _runs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each stands there."""
    packed = np.sort(packed)
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
    return packed[first], np.diff(np.r_[first, len(packed)])


def filled_cells(docs: DataFrame, cells: int) -> tuple[int, np.ndarray]:
    """Number of documents, and the occurrences of all terms of each cell. Cells travel in blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(word_table())
    names = ["block", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(cells, np.int64), 0
        for batch in batches:
            for _, n, (row, code, words) in _pieces(batch, shared.value):
                own, hashes = _cells(words, cells)
                pair = np.flatnonzero(row[1:] == row[:-1])
                held += np.bincount(own[code], minlength=cells)
                held += np.bincount(_pair_cells(hashes, code[pair], code[pair + 1], cells), minlength=cells)
                rows += n
        at = range(0, cells, BLOCK)
        sums = [np.array([rows]).tobytes(), *(held[k:k + BLOCK].tobytes() for k in at)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array(sums, pa.binary())], names=names)

    def added(block: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n.as_py(), np.int64) for n in block.column("n"))
        return pa.table([block.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=names)

    blocks = docs.select("text").mapInArrow(count, "block long, n binary").groupBy("block").applyInArrow(added, "block long, n binary")
    sums = {r.block: np.frombuffer(r.n, np.int64) for r in blocks.collect()}
    return int(sum(sums.pop(-1, np.zeros(1, np.int64)))), np.concatenate([sums[k] for k in sorted(sums)] or [np.zeros(cells, np.int64)])


def counted(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """term, cf, df of all terms in the chosen cells (a flag per cell)."""
    context = docs.sparkSession.sparkContext
    shared, wanted, cells = context.broadcast(word_table()), context.broadcast(chosen), len(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            for _, n, (row, code, words) in _pieces(batch, shared.value):
                own, hashes = _cells(words, cells)
                pair = np.flatnonzero(row[1:] == row[:-1])
                pair = pair[flags[_pair_cells(hashes, code[pair], code[pair + 1], cells)]]
                single = np.flatnonzero(flags[own][code])
                # A term and its text in one number: second word (0: none), first word, text.
                base = len(words) + 1
                packed = np.r_[code[single], (code[pair + 1] + 1) * base + code[pair]] * n + np.r_[row[single], row[pair]]
                met, tf = _runs(packed)
                if not len(met):
                    continue
                key = met // n
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                key, df, cf = key[first], np.diff(np.r_[first, len(met)]), np.add.reduceat(tf, first)
                one = int(np.searchsorted(key, base))
                pairs = pc.binary_join_element_wise(words.take(pa.array(key[one:] % base)), words.take(pa.array(key[one:] // base - 1)), " ")
                text = pa.concat_arrays([words.take(pa.array(key[:one])), pairs])
                yield pa.RecordBatch.from_arrays([text, pa.array(cf), pa.array(df)], names=["term", "cf", "df"])

    found = docs.select("text").mapInArrow(count, "term string, cf long, df long")
    return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, min_df: int = 2, max_df: float = 0.95,
               max_features: int = MAX_VOCABULARY, cells: int = CELLS) -> DataFrame:
    """Most frequent terms within the document-frequency bounds: term, df, idf, idx.

    A term outside the chosen cells is less frequent than the emptiest of them. So the terms found are the right ones if
    the last of them is as frequent as that cell; if not, cells as full as the last term (or all that can hold a
    term within the bounds, where terms are too few) hold all that is missing.
    """
    ensure_checkpoints(docs.sparkSession)
    size, held = filled_cells(docs, cells)
    # Twice as many cells as terms, as some terms fall to the bounds and some cells are full of rare terms.
    least = max(int(np.sort(held)[-2 * max_features]) if 2 * max_features <= cells else 0, 1)
    while True:
        within = (F.col("df") >= min_df) & (F.col("df") <= F.lit(size) * max_df)
        best = counted(docs, held >= least).filter(within).orderBy(F.col("cf").desc(), "term").limit(max_features)
        # At most max_features rows; written, as the next steps and the caller read them.
        best = best.checkpoint()
        found, last = best.agg(F.count("*"), F.min("cf")).first()
        needed = last if found == max_features and found else max(min_df, 1)
        if least <= needed:
            break
        least = needed
    idf = F.log((1.0 + F.lit(size)) / (1.0 + F.col("df"))) + 1.0
    # At most max_features rows, so one task orders them.
    return best.select("term", "df", idf.alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"))


def frequencies(docs: DataFrame, vocab: DataFrame, id_column: str) -> DataFrame:
    """(id, idx, tf) of the terms of the vocabulary in every row."""
    context = docs.sparkSession.sparkContext
    listed = vocab.select("term", "idx").toArrow().to_pydict()
    shared, known = context.broadcast(word_table()), context.broadcast(list(zip(listed["term"], listed["idx"], strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = [(term, i) for term, i in known.value if " " not in term]
        pairs = [(*term.split(" "), i) for term, i in known.value if " " in term]
        parts = sorted({word for a, b, _ in pairs for word in (a, b)})
        place = {word: k for k, word in enumerate(parts)}
        # What is not found has the place -1: the last entry of the arrays.
        single_words, single_idx = pa.array([term for term, _ in singles], pa.string()), np.array([i for _, i in singles] + [-1], np.int64)
        part_words = pa.array(parts, pa.string())
        keys = np.array([place[a] * len(parts) + place[b] for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        keys, pair_idx = np.r_[keys[order], -1], np.r_[np.array([i for _, _, i in pairs], np.int64)[order], -1]
        size = len(known.value)

        def places(words: pa.Array, among: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.index_in(words, among), -1).to_numpy()

        for batch in batches:
            for at, _, (row, code, words) in _pieces(batch, shared.value):
                single, part = single_idx[places(words, single_words)][code], places(words, part_words).astype(np.int64)[code]
                pair = np.flatnonzero((row[1:] == row[:-1]) & (part[1:] >= 0) & (part[:-1] >= 0))
                wanted = part[pair] * len(parts) + part[pair + 1]
                found = np.searchsorted(keys[:-1], wanted)
                double = np.where(keys[found] == wanted, pair_idx[found], -1)
                met, tf = _runs(np.r_[row[single >= 0] * size + single[single >= 0], row[pair][double >= 0] * size + double[double >= 0]])
                if len(met):
                    own = batch.column(0).take(pa.array(at + met // size))
                    yield pa.RecordBatch.from_arrays([own, pa.array((met % size).astype(np.int32)), pa.array(tf)], names=[id_column, "idx", "tf"])

    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("idx", T.IntegerType()), T.StructField("tf", T.LongType())])
    return docs.select(id_column, "text").mapInArrow(count, schema)


def weights(docs: DataFrame, vocab: DataFrame, id_column: str) -> DataFrame:
    """Sublinear tf x idf with unit length per document: (id, term, idx, weight).

    The vocabulary has at most a few thousand rows and is broadcast. A row sends every term it has once, with its
    number, to its document.
    """
    tf = frequencies(docs, vocab, id_column).repartition(id_column).groupBy(id_column, "idx").agg(F.sum("tf").alias("tf"))
    named = tf.join(F.broadcast(vocab.select("idx", "idf", "term")), "idx")
    raw = named.withColumn("w", (F.log("tf") + 1.0) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_column)))
    return raw.select(id_column, "term", "idx", (F.col("w") / norm).alias("weight"))


def sparse_vectors(weighted: DataFrame, id_column: str, size: int, documents: DataFrame | None = None) -> DataFrame:
    """One vector per document, kept sparse; a document has at most `size` entries.

    With `documents`, those without a weighted term get a vector of zeros.

    The entries are laid out as an array with zeros in the gaps; the assembler then
    stores whichever form is smaller. All of it runs inside one projection.
    """
    packed = weighted.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_e"))
    if documents is not None:
        none = F.array().cast("array<struct<idx:int,weight:double>>")
        packed = documents.select(id_column).join(packed, id_column, "left").withColumn("_e", F.coalesce("_e", none))
    place = F.transform("_e", lambda e: e["idx"])

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0.0), count.cast("int"))

    cells = F.transform(
        "_e",
        lambda e, i: F.concat(
            zeros(e["idx"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(place, i - 1)) - 1), F.array(e["weight"])
        ),
    )
    tail = zeros(F.lit(size - 1) - F.coalesce(F.array_max(place), F.lit(-1)))
    dense = packed.select(id_column, array_to_vector(F.concat(F.flatten(cells), tail)).alias("_dense"))
    return VectorAssembler(inputCols=["_dense"], outputCol="features").transform(dense).drop("_dense")
