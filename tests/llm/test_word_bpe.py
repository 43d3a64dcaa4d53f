import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwell.llm import word_bpe
from tests.llm.helpers import frame

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.no_truncation()
DEFINITION = word_bpe.definition_of()
BPE = word_bpe.WordBpe(DEFINITION)


def brute(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def own(text):
    ids = BPE.encode([text])[0].tolist()
    return len(ids), " ".join(map(str, ids)), BPE.decode(ids)


@given(st.text(st.sampled_from(list("abcdeths'SÉéß \n\t́\x1c\x85​1.,<|>")) | st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_text_as_the_library(text):
    assert own(text) == brute(text)


@given(st.text("aeinorsthdl", min_size=1, max_size=30))
@settings(max_examples=500, deadline=None)
def test_words_as_the_library(word):
    assert own(word) == brute(word)


def test_special_cases():
    for text in ["", " \n", "<|startoftext|>Hello<|endoftext|>", "<|STARTOFTEXT|>", "a</w>b </w>", "ΣΑΣ ΟΔΟΣ", "İstanbul", "don't we'll I'M", " x　y",
                 "á é", "́a", "ﬁ ½ ²", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", "aaaaaaaaaaaaaaaa", "a" * 3000, "x" * 500 + " y"]:
        assert own(text) == brute(text), text


def test_syllables_and_failing_words():
    rng = random.Random(9)
    parts = "th nd ea ing ion er an re he on at en ha es st un ge sch ver ung lich é è ñ ó".split()
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(4000)]
    text = " ".join(words)
    before = BPE.tried, BPE.merged
    assert own(text) == brute(text)
    tried, merged = BPE.tried - before[0], BPE.merged - before[1]
    assert 0 < merged < tried  # both ways were taken


def test_one_long_word_in_seconds():
    rng = random.Random(4)
    for text in ("".join(rng.choices("etaoinshrdlu", k=1_000_000)), "ab" * 100_000, "z" * 200_000):
        start = time.process_time()
        got = own(text)
        assert time.process_time() - start < 60
        assert got == brute(text)


def test_side_by_side_merging_is_merging():
    rng = random.Random(5)
    words = [word_bpe.ended("".join(rng.choices("aeinorsthdlé日", k=rng.randrange(1, 40)))) for _ in range(3000)] + [word_bpe.ended("x")] * 3
    assert [np.frombuffer(b, "<u2").tolist() for b in BPE.exact_many(words)] == [BPE.exact(w) for w in words]
    assert BPE.exact_many([]) == [] and BPE.encode_words([]) == []


def test_generations_of_the_caches(monkeypatch):
    monkeypatch.setattr(word_bpe, "WORDS", 3)
    bpe, rng = word_bpe.WordBpe(DEFINITION), random.Random(6)
    for _ in range(60):
        text = " ".join("".join(rng.choices("ab.", k=2)) for _ in range(6))
        assert bpe.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(bpe.known) <= 12


def test_compatible_against_merging():
    rng = np.random.default_rng(2)
    tokens = [i for i in rng.integers(0, BPE.size, 4000).tolist() if i in BPE.inner and ord(BPE.inner[i][-1]) < word_bpe.END and BPE.inner[i] in BPE.proposed]
    second = [i for i in rng.integers(0, BPE.size, 4000).tolist() if i in BPE.inner and ord(BPE.inner[i][-1]) >= word_bpe.END and BPE.inner[i] in BPE.proposed]
    n = min(len(tokens), len(second))
    a, b = np.array(tokens[:n]), np.array(second[:n])
    good = BPE.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        assert ok == (BPE.exact(BPE.inner[x] + BPE.inner[y]) == [x, y])
    assert 0 < good.sum() < n


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "The quick BROWN fox."), (3, "The quick BROWN fox."), (None, "x"), (4, "long words here " * 50000)]
    odd = frame(spark, rows).withColumns({c: F.lit("z") for c in ("found", "ids", "n_tokens")})
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(str((i, n, digest(a), digest(b))) for i, t in rows for n, a, b in [brute(t)])
    assert sorted(str(tuple(r)) for r in word_bpe.encoded(odd, DEFINITION).collect()) == want
    assert word_bpe.encoded(frame(spark, []), DEFINITION).count() == 0
    out = word_bpe.stage(spark, odd, "").filter("doc_id = 3").first()
    assert BPE.decode(out.ids) == brute("The quick BROWN fox.")[2] and out.n_tokens == len(out.ids)


def test_answers_leave_in_pieces_of_a_batch():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeinorst", k=6)) for _ in range(n)) for n in [20_000, 1, 0, 30_000, 30_000, 200_000, 5]] * 3
    together = []

    class Watched(word_bpe.WordBpe):
        def encode(self, texts):
            together.append((len(texts), sum(len(t) for t in texts)))
            return super().encode(texts)

    batch = pa.array(["skipped", *texts], pa.string()).slice(1)
    pieces = word_bpe.answers(Watched(DEFINITION), iter([batch, batch.slice(0, 0)]), ids=True)
    first = next(pieces)
    assert len(together) == 1 and len(first) < len(texts)
    rows = [r for piece in (first, *pieces) for r in piece.to_pylist()]
    assert all(n == 1 or held <= word_bpe.TOGETHER for n, held in together)
    assert [r["ids"] for r in rows] == [ids.tolist() for ids in BPE.encode(texts)]
    assert [r["n_tokens"] for r in rows] == [len(r["ids"]) for r in rows]
