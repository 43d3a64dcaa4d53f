"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens that fit. Byte-pair merging gives exactly that cut if every two
adjacent tokens are compatible: if merging the two on their own would leave the boundary between them alone. That is
settled for all distinct pairs of a batch at once, by undoing the merges on both sides of the boundary, latest first,
and looking for a merge across it that would have come earlier. Only words with an incompatible pair are merged
exactly: short ones side by side, a merge of every word at a time; long ones with a heap of the pairs, so that the work
for a word of n characters grows as n log n. Words repeat, so each worker keeps a bounded memory of the words it has
met, as packed ids.

The tokenizer is read from its definition file: normal form C, white space collapsed, lower case; words by the file's
pattern; bytes as characters; a mark at the end of every word. Special tokens in a text are found before all that.

Defined cases: a null or empty text and one of white space alone has no tokens and decodes to the empty text. Every
row is encoded on its own, so repeated rows and rows that share a doc_id or have none give a row each; an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import batches_by_bytes, pick, worker_store
from driftwell.llm.pieces import Cut, cut_at_blanks, laid_out

WORDS = 100_000  # words of a generation of the cache
SHORT = 64  # characters of words that are merged side by side
TOGETHER = 1 << 20  # bytes of text that are encoded together
NEVER = int(np.iinfo(np.int64).max)
END = 0x1000  # added to a word's last character: the form that carries the end-of-word mark


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def ended(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + END)


class WordBpe:
    """Encoder and decoder of a tokenizer definition with an end-of-word mark."""

    def __init__(self, definition: str):
        import ahocorasick
        import regex

        spec = json.loads(definition)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.blank_special = any(" " in t for t in self.special)
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        steps = [s["type"] for s in spec["normalizer"].get("normalizers", [spec["normalizer"]])]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"the file normalises by {steps}; this encoder knows normal form C, white space and lower case")
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.shown = dict(enumerate(byte_characters()))
        self.text = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = token
        inner = lambda t: ended(t.removesuffix(suffix)) if t.endswith(suffix) and t != suffix else t
        self.ids = {inner(t): i for t, i in vocab.items()}
        self.inner = {i: t for t, i in self.ids.items()}
        self.lengths = np.array([len(self.inner.get(i, "")) for i in range(len(self.text))])
        self.number = [str(i) for i in range(len(self.text))]
        # born: the rank of the merge that makes a token, -1 for single characters; left and right: what it merges.
        size = len(self.text)
        self.born, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            merges[x, y] = (rank, made)
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, x, y
        keys = np.array([x * size + y for x, y in merges], np.int64)
        order = np.argsort(keys)
        ranked = np.array(list(merges.values()), np.int64).reshape(-1, 2)[order]
        self.pair_keys, self.pair_ranks, self.pair_made = keys[order], ranked[:, 0], ranked[:, 1]
        self.size = size
        self.ranks = {x * size + y: r for (x, y), (r, _) in merges.items()}
        self.made = {x * size + y: m for (x, y), (_, m) in merges.items()}
        # What may be proposed: tokens that merging their own characters gives. No token goes on after an ended
        # character, so words can follow one another in one string.
        self.proposed = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self.exact(token) == [i]:
                self.proposed.add_word(token, i)
        self.proposed.make_automaton()
        # The id of a character by its code point, -1 for characters without one.
        self.single = np.full(max((ord(c) for c in self.ids if len(c) == 1), default=0) + 2, -1, np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # Packed ids of words, in a present and a former generation.
        self.known: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}
        self.tried = self.merged = 0

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return at, self.pair_keys[at] == keys

    def across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of every pair, NEVER if there is none."""
        at, known = self._pair(a, b)
        return np.where(known, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For every pair of tokens: does merging their characters leave the boundary between them alone?

        x and y are the pieces at the boundary at some moment of the merging, seen backwards; gone_x and gone_y are
        the ranks at which they disappear into larger pieces. A merge across that comes before both wins. Of equal
        ranks the leftmost merge comes first: one that swallows x precedes, one that swallows y does not.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        gone_x, gone_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(open_):
            rank = self.across(x, y)
            crossed = (rank < gone_x) & ((rank < gone_y) | ((rank == gone_y) & (rank < NEVER)))
            good[open_[crossed]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~crossed & ((born_x >= 0) | (born_y >= 0))
            undo_x = born_x > born_y
            gone_x, gone_y = np.where(undo_x, born_x, gone_x)[go], np.where(undo_x, gone_y, born_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            open_ = open_[go]
        return good

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of all words one after the other: the longest token that fits, again and again."""
        found = np.array(list(self.proposed.iter_long("".join(words))), np.int64).reshape(-1, 2)
        return found[:, 1], found[:, 0] + 1

    def exact(self, text: str) -> list[int]:
        """Merging as defined: of all adjacent pairs the one of lowest rank, the leftmost first.

        The pairs wait in a heap by (rank, place). A merged piece stays at its left place; what waits for a place that
        has changed since is passed over.
        """
        pieces = [self.ids[c] for c in text if c in self.ids]
        n, size, ranks, made = len(pieces), self.size, self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r << 40) | i for i, (x, y) in enumerate(zip(pieces, pieces[1:], strict=False)) if (r := ranks.get(x * size + y)) is not None]
        heapq.heapify(waiting)
        place = (1 << 40) - 1
        while waiting:
            entry = heapq.heappop(waiting)
            i = entry & place
            j = after[i]
            if pieces[i] < 0 or j >= n:
                continue
            key = pieces[i] * size + pieces[j]
            if ranks.get(key) != entry >> 40:
                continue
            pieces[i], pieces[j] = made[key], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(pieces[i] * size + pieces[k])) is not None:
                    heapq.heappush(waiting, (r << 40) | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(pieces[h] * size + pieces[i])) is not None:
                heapq.heappush(waiting, (r << 40) | h)
        return [p for p in pieces if p >= 0]

    def exact_many(self, words: list[str]) -> list[bytes]:
        """Packed ids of many short words: in every round each word makes its next merge."""
        out = [b""] * len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ids = self.single[np.minimum(chars, len(self.single) - 1)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])[ids >= 0]
        ids = ids[ids >= 0]
        rank = np.full(len(ids), NEVER)  # of the pair that begins here; NEVER at the end of a word
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.across(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            if done.any():
                packed = ids.astype(self.kind)
                for start, size in zip(starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[word[start]] = packed[start:start + size].tobytes()
                stays = np.repeat(~done, sizes)
                ids, word, rank = ids[stays], word[stays], rank[stays]
                sizes, least = sizes[~done], least[~done]
            if not len(ids):
                break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            ids[at] = self.pair_made[self._pair(ids[at], ids[at + 1])[0]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            moved = at - np.arange(len(at))  # every word before has lost one piece
            ids, word, rank = ids[stays], word[stays], rank[stays]
            for left in (moved - 1, moved):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                same = word[left] == word[left + 1]
                rank[left[same]] = self.across(ids[left[same]], ids[left[same] + 1])
                rank[left[~same]] = NEVER
            if len(moved) and moved[-1] == len(ids) - 1:
                rank[-1] = NEVER
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of ended words."""
        if not words:
            return []
        flat, ends = self.greedy(words)
        stops = np.cumsum([len(w) for w in words])
        word_of = np.searchsorted(stops, ends)
        first = np.searchsorted(word_of, np.arange(len(words) + 1))
        # A cut is a proposal only if its tokens cover the word without a gap.
        covered = np.bincount(word_of, np.diff(np.r_[0, ends]), len(words)) if len(ends) else np.zeros(len(words))
        sure = (covered == np.diff(np.r_[0, stops])) & (np.diff(first) > 0)
        sure[word_of[self._gaps(flat, ends)]] = False
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        if len(inside):
            pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            sure[word_of[inside[~self.compatible(pairs // self.size, pairs % self.size)[which]]]] = False
        self.tried += len(words)
        self.merged += int((~sure).sum())
        width, packed = self.kind.itemsize, flat.astype(self.kind).tobytes()
        out = [packed[a * width:b * width] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        failed = np.flatnonzero(~sure).tolist()
        short = [i for i in failed if len(words[i]) <= SHORT]
        for i, ids in zip(short, self.exact_many([words[i] for i in short]), strict=True):
            out[i] = ids
        for i in failed:
            if len(words[i]) > SHORT:
                out[i] = self.packed(self.exact(words[i]))
        return out

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _gaps(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens that do not begin where the one before ended."""
        return np.flatnonzero(ends - self.lengths[flat] != np.r_[0, ends[:-1]])

    def cut(self, text: str) -> list[str | int]:
        """The words of a raw text, in their normal form, and the ids of special tokens."""
        if text.isalpha() and text.isascii():
            return [text.lower()]
        if self.specials is None or self.specials.search(text) is None:
            return self.words.findall(self.normal(text))
        out: list[str | int] = []
        for section in self.specials.split(text):
            out += [self.special[section]] if section in self.special else self.words.findall(self.normal(section))
        return out

    def normal(self, text: str) -> str:
        """Normal form C in lower case. White space needs no collapsing, as no word holds any. Lower case goes character
        by character: a sigma has one lower form wherever it stands."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, words: set[str]) -> None:
        """Make the packed ids of words known."""
        missing = []
        for word in words - self.known.keys():
            ids = self.old_known.get(word)
            if ids is None:
                missing.append(word)
            else:
                self.known[word] = ids
        shown = [ended(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown)) for w in missing]
        self.known.update(zip(missing, self.encode_words(shown), strict=True))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens as they are, a space between them. Unknown ids are left out."""
        return " ".join([self.text[i] for i in ids if 0 <= i < self.size])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text. White space ends every word, so the pieces between blanks are cut into words
        on their own, each distinct one once."""
        if not texts:
            return []
        if self.blank_special:
            cut = Cut(texts, np.arange(len(texts)), np.arange(1, len(texts) + 1))
        else:
            cut = cut_at_blanks(texts)
        words = list(map(self.cut, cut.distinct))
        met = set(chain.from_iterable(words))
        special = {p for p in met if not isinstance(p, str)}
        self.learn(met - special)
        found = self.known if not special else self.known | {i: self.packed([i]) for i in special}
        ids = found.__getitem__
        out = laid_out(cut, [ids(ws[0]) if len(ws) == 1 else b"".join(map(ids, ws)) for ws in words], self.kind)
        if len(self.known) > WORDS:
            self.old_known, self.known = self.known, {}
        return out


def answers(bpe: WordBpe, batches: Iterator[pa.Array], ids: bool = False) -> Iterator[pa.StructArray]:
    """n_tokens, ids_sha256, decoded_sha256 (and ids) of every text, a piece of a batch at a time: a batch's texts, ids
    and what is made on the way are never held all at once."""
    number = bpe.number
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for batch in batches:
        sizes, at = pc.binary_length(batch).to_pylist(), 0
        # A batch without rows has an answer without rows.
        while at < len(sizes) or not sizes:
            upto, held = at, 0
            while upto < len(sizes) and (upto == at or held + sizes[upto] <= TOGETHER):
                held += sizes[upto]
                upto += 1
            counts, first, second, lists = [], [], [], []
            for found in bpe.encode(batch.slice(at, upto - at).to_pylist()):
                listed = found.tolist()
                counts.append(len(listed))
                first.append(digest(" ".join([number[i] for i in listed])))
                second.append(digest(bpe.decode(listed)))
                if ids:
                    lists.append(found.astype(np.int32))
            at = upto
            columns = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                # Flat numbers and offsets: a Python list of all ids would take ten times the space.
                flat = np.concatenate([np.zeros(0, np.int32), *lists])
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, "ids"]
            yield pa.StructArray.from_arrays(columns, names=names)
            if not sizes:
                break


def coded(spark: SparkSession, text: Column, definition: str, ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256), and the ids as a list if asked for."""
    batches_by_bytes(spark)
    shared = spark.sparkContext.broadcast(definition)
    extra = ", ids array<int>" if ids else ""

    @F.arrow_udf(f"n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = worker_store("word_bpe")
        if store.get("definition") != hash(shared.value):
            store["bpe"], store["definition"] = WordBpe(shared.value), hash(shared.value)
        yield from answers(store["bpe"], batches, ids)
        pa.default_memory_pool().release_unused()

    return compute(F.coalesce(text, F.lit("")))


def definition_of(path: str | None = None) -> str:
    """The text of a tokenizer file, by default the word tokenizer."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(docs: DataFrame, definition: str, ids: bool = False) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids)."""
    rows = pick(docs, "doc_id", "text")
    found = rows.select("doc_id", coded(docs.sparkSession, F.col("text"), definition, ids).alias("found"))
    return found.select("doc_id", "found.*")


def op5_word_bpe(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    return encoded(spark.read.parquet(f"{folder}/documents.parquet"), definition_of(tokenizer))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The token ids of every row, with their number and digests."""
    return encoded(docs, definition_of(), ids=True)
