"""Token ids as binary blocks with Elias-Fano document boundaries.

File format: a Parquet table, so that any store Spark writes to will do and a lost task's output is never half seen.
Every row is a block of whole documents in ascending doc_id order:

    shard, block   long    place of the block; all ids of a shard precede those of the next
    start          long    ids of the shard before this block
    n_ids          long    ids in this block
    doc_ids        array   the documents, in order
    width          int     bytes of an id (2 or 4, little-endian)
    ids            binary  all ids of the block, one after the other
    low_bits       int     Elias-Fano of the documents' ends within the block: how many low bits are kept as they are
    low, high      binary  those bits, packed; and the unary code of the rest
    samples        binary  for every 256th document the position of its bit in `high` (unsigned 32 bits)

A boundary costs about 2 + log2(ids / documents) bits; no table of 64-bit offsets exists. The position of a shard in
the whole array follows from the totals of the shards, one row each.

Defined cases: a null text counts as empty and holds the end id alone; a null doc_id comes first; rows that share a
doc_id are ordered by a hash of their text; an empty table gives no blocks.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import join_small, pick, worker_store
from driftwell.llm.pieces import Cut, laid_out
from driftwell.session import scratch_path

END_ID = 2
BLOCK_IDS = 1 << 18
SAMPLED = 256
BYTES = 1 << 23  # of text that are encoded together
WORDS_KEPT = 500_000  # words of a generation of the cache
LENGTH_KEPT = 64  # characters of a word that is kept
SCHEMA = ("shard long, block long, start long, n_ids long, doc_ids array<long>, width int, ids binary, low_bits int, "
          "low binary, high binary, samples binary")


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        kept = (values[:, None] >> np.arange(bits)) & 1
        low = np.packbits(kept.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        at = (values >> bits) + np.arange(n)
        unary = np.zeros((top >> bits) + n + 1, np.uint8)
        unary[at] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").tobytes(), at[::SAMPLED].astype("<u4").tobytes())

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        begin, end = first * self.low_bits, last * self.low_bits
        part = np.frombuffer(self.low, np.uint8)[begin // 8:(end + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[begin % 8:begin % 8 + end - begin].reshape(-1, self.low_bits)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)

    def select(self, i: int) -> int:
        """The i-th value, read from the sample before it on."""
        position = int(np.frombuffer(self.samples, "<u4")[i // SAMPLED])
        missing, words = i % SAMPLED, np.frombuffer(self.high, np.uint8)
        byte = position // 8
        head = int(words[byte]) >> (position % 8) << (position % 8)
        missing += 1
        while (found := head.bit_count()) < missing:
            missing -= found
            byte += 1
            head = int(words[byte])
        for _ in range(missing - 1):
            head &= head - 1
        at = byte * 8 + (head & -head).bit_length() - 1
        return ((at - i) << self.low_bits) | int(self._low(i, i + 1)[0])


# Kinds of characters; white space is SPACE and what follows it here.
LETTER, DIGIT, MARK, HARD, SPACE, LINE, BLANK_KIND = range(7)
BLANK = "\u0120"  # stands for the byte of a blank


def kind_of(code: int) -> int:
    """What the tokenizer takes a character of the first plane for, where every version of Unicode agrees; else HARD.

    HARD, too: an apostrophe, which may begin a word of its own, and a surrogate. SPACE: control and format characters
    as well, some of which are white space in one version only.
    """
    char = chr(code)
    if char in " \n":
        return BLANK_KIND if char == " " else LINE
    now, then = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if char.isspace() or now in ("Cc", "Cf") or then[0] == "Z":
        return SPACE
    if char == "'" or now[0] != then[0] or now[0] == "C":
        return HARD
    if now[0] == "N":
        return DIGIT if char.isascii() else HARD
    return LETTER if now[0] == "L" else MARK


def kinds_of(data: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8, that of its character; characters beyond the first plane are HARD."""
    ascii_kinds = plane[:128].tobytes() + bytes([HARD]) * 128
    kinds = np.frombuffer(bytearray(data).translate(ascii_kinds), np.uint8)
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    if len(two):
        kinds[two] = kinds[two + 1] = plane[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    if len(three):
        codes = ((data[three] & 0x0F).astype(np.int64) << 12) | ((data[three + 1] & 0x3F).astype(np.int64) << 6) | (data[three + 2] & 0x3F)
        kinds[three] = kinds[three + 1] = kinds[three + 2] = plane[codes]
    return kinds


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Encoder:
    """The tokenizers library over whole texts, with a bounded memory of the words it has met.

    A blank before anything but white space always begins a token, and within a piece between such blanks so does every
    change of kind, if the piece has no HARD character, no white space but single line ends. So such a piece is cut into
    words, and the library's model encodes each new word; any other piece, and a text with other blanks or an added token,
    goes through the whole library as it is.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.shown = byte_characters()
        # Only with the byte-level cut, and nothing before it, are pieces between blanks independent.
        spec = json.loads(definition)
        cut = spec.get("pre_tokenizer") or {}
        self.by_pieces = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]  # no text with one of them is cut here
        self.plane = np.fromiter(map(kind_of, range(1 << 16)), np.uint8, 1 << 16)
        # Packed ids of words, in a present and a former generation.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._packed(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _modelled(self, words: list[str]) -> list[bytes]:
        tokenize, shown = self.model.tokenize, self.shown
        return self._packed([t.id for t in tokenize(w.replace(" ", BLANK) if w.isascii() and w != "\n" else w.encode().decode("latin-1").translate(shown))] for w in words)

    def _packed(self, lists: Iterable[list[int]]) -> list[bytes]:
        """Each list as bytes. No list is kept, as many of them would set off the garbage collector again and again."""
        flat, ends = array(self.kind.char), [0]
        for ids in lists:
            flat.extend(ids)
            ends.append(len(flat) * self.width)
        line = np.frombuffer(flat, flat.typecode).astype(self.kind).tobytes()
        return [line[a:b] for a, b in pairwise(ends)]

    def _cut(self, texts: pa.LargeStringArray) -> tuple[Cut, list[bool]]:
        """All texts as words, and for each distinct one whether it needs the whole library."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return Cut([], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)), []
        kinds = kinds_of(data, self.plane)
        filled = bounds[:-1] < bounds[1:]
        begins, lasts = bounds[:-1][filled], bounds[1:][filled] - 1
        blank = kinds == BLANK_KIND
        starts = blank.copy()
        starts[1:] |= (kinds[1:] != kinds[:-1]) & ~blank[:-1]
        starts[begins] = True
        at = np.flatnonzero(starts)

        # Pieces that need the library whole: their inner starts go.
        lines = kinds == LINE
        hard = (kinds == HARD) | (kinds == SPACE)
        hard[1:] |= lines[1:] & lines[:-1]
        heads = blank[at]
        heads[np.searchsorted(at, begins)] = True
        piece = np.cumsum(heads) - 1
        joined = np.zeros(int(piece[-1]) + 1, bool)
        joined[piece[np.searchsorted(at, np.flatnonzero(hard), "right") - 1]] = True
        joined = joined[piece]
        kept = heads | ~joined

        # Texts that do.
        before_white = np.append(kinds[1:] >= SPACE, True)
        before_white[lasts] = True
        apart = np.searchsorted(bounds, np.flatnonzero(blank & before_white), "right") - 1
        marked = [np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)) for t in self.added]
        for i in np.unique(np.concatenate([apart, *marked])).tolist():
            first, last = np.searchsorted(at, bounds[i:i + 2]).tolist()
            kept[first + 1:last] = False
            joined[first] = True

        at, joined = at[kept], joined[kept]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        which = words.indices.to_numpy().astype(np.int64)
        library = np.zeros(len(words.dictionary), bool)
        library[which[joined]] = True
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        return Cut(distinct, which, np.searchsorted(at, bounds[1:])), library.tolist()

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        if not len(texts):
            return []
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.by_pieces:
            return [np.frombuffer(ids, self.kind) for ids in self._whole(texts.to_pylist())]
        cut, library = self._cut(texts)
        return laid_out(cut, self._known(cut.distinct, library), self.kind)

    def _known(self, words: list[str], library: list[bool]) -> list[bytes]:
        """Packed ids of words; those marked are for the whole library."""
        found = list(map(self.words.get, words))
        fresh: list[list[int]] = [[], []]
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := self.old_words.get(words[k])) is None:
                fresh[library[k]].append(k)
            else:
                self.words[words[k]] = found[k] = ids
        plain = self._modelled([words[k] for k in fresh[0]])
        for k, ids in chain(zip(fresh[0], plain, strict=True), zip(fresh[1], self._whole([words[k] for k in fresh[1]]), strict=True)):
            found[k] = ids
            if len(words[k]) <= LENGTH_KEPT:
                self.words[words[k]] = ids
        if len(self.words) > WORDS_KEPT:
            self.old_words, self.words = self.words, {}
        return found


def write_task(shared, end_id: int):
    """Task function: (doc_id, text) in order to blocks. The task's partition number is the shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("token_files")
        if store.get("definition") != hash(shared.value):
            store["encoder"], store["definition"] = Encoder(shared.value), hash(shared.value)
        encoder: Encoder = store["encoder"]
        end = np.array([end_id], encoder.kind)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def settle() -> pa.RecordBatch:
            ends = np.cumsum([len(p) + 1 for p in parts])
            coded = EliasFano.of(ends)
            row = {"shard": shard, "block": block, "start": start, "n_ids": int(ends[-1]), "doc_ids": docs, "width": encoder.width, "ids": np.concatenate([x for p in parts for x in (p, end)]).tobytes(),
                   "low_bits": coded.low_bits, "low": coded.low, "high": coded.high, "samples": coded.samples}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            after = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(texts):
                # A few documents at a time: what is held does not grow with the batch.
                held = int(after[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(after, held + BYTES, "right")))
                for doc, found in zip(ids[at:upto], encoder.encode(texts.slice(at, upto - at)), strict=True):
                    docs.append(doc)
                    parts.append(found)
                    size += len(found) + 1
                    if size >= BLOCK_IDS:
                        yield settle()
                        block, start, docs, parts, size = block + 1, start + size, [], [], 0
                at = upto
        if docs:
            yield settle()

    return write


BLOCK = pa.schema([
    ("shard", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()),
    ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()),
])


def write_tokens(docs: DataFrame, definition: str, path: str, end_id: int = END_ID) -> None:
    """Encode all documents and write them in ascending doc_id order. The definition is a tokenizer file's text."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(write_task(shared, end_id), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_task():
    """Task function: blocks with the place of their shard to (doc_id, start, ids packed as 32 bits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(len(row["doc_ids"]), row["low_bits"], row["low"], row["high"], row["samples"]).all()
                starts = np.r_[0, ends[:-1]]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                base = row["base"] + row["start"]
                crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # One row per shard, that is per task of the writer.
    bases = totals.selectExpr("shard", "coalesce(sum(total) over (order by shard rows between unbounded preceding and 1 preceding), 0L) as base")
    return join_small(blocks, bases, ["shard"], "inner").mapInArrow(read_task(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _span_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with places of documents in them to (doc_id, ids); only the spans asked for are decoded."""
    for batch in batches:
        for row in batch.to_pylist():
            ends = EliasFano(len(row["doc_ids"]), row["low_bits"], row["low"], row["high"], row["samples"])
            ids = np.frombuffer(row["ids"], f"<u{row['width']}")
            spans = [ids[ends.select(i - 1) if i else 0:ends.select(i)].astype(np.int64) for i in row["places"]]
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][i] for i in row["places"]], pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents that `wanted` names, end id included; ids nobody wrote give no row.

    A document's span lies between two boundaries, which select finds without decoding the others.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    asked = pick(wanted, "doc_id").distinct()
    listed = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = listed.join(asked, "doc_id").groupBy(F.col("shard").alias("s"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list("place")).alias("places"))
    met = blocks.join(places, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    return met.mapInArrow(_span_task, "doc_id long, ids array<long>")


def op1_token_files(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), definition, path)
    return read_tokens(spark, path)
