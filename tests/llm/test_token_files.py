import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwell.llm import token_files
from tests.llm.helpers import frame

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
DEFINITION = open(FILE, encoding="utf-8").read()
ENCODER = token_files.Encoder(DEFINITION)


def brute(rows):
    start, out = 0, []
    for i, text in rows:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@given(st.text(st.sampled_from(list("ab \n\t\r\x0b\x1c\x85\xa0 'sé日🙂1.,<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_as_whole_texts(text):
    got = ENCODER.encode([text])[0].tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_strings():
    for text in ("<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>x  y", "a  b   c \n d\n\n e ", " ", "  ", "　a 　b"):
        assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_character_of_the_first_plane():
    for setting in ("a{}b", "x,{} 1{}\n{}", " {}"):
        texts = [setting.replace("{}", chr(c)) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
        want = LIBRARY.encode_batch(texts, add_special_tokens=False)
        assert all(g.tolist() == w.ids for g, w in zip(ENCODER.encode(texts), want, strict=True))


def test_plain_texts_are_known_by_words(monkeypatch):
    encoder, whole = token_files.Encoder(DEFINITION), []
    library = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: whole.extend(texts) or library(texts))
    texts = ["Red blue, 12 über. „Red“ – blue!\nRed blue; 12,", "", "Red. blue\n 日本, (blue) 12."]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    # Neither a text's first word, a number nor a word with marks around it goes through the library or is kept apart.
    assert not whole and set(encoder.words) == {"Red", " blue", "blue", ",", " 12", " über", ".", " „", "“", " –", "!", "\n", ";", " 日本", " (", ")"}


def test_part_of_a_column_and_mixed_texts():
    texts = ["cut off", "", "it's  two", "a\n\nb c", " ", "x <|endoftext|>y z", "🙂 x🙂 y", "\tz\r\n 1", "", "long " + "q" * 300, "end "]
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        for first in range(len(texts)):
            for last in range(first, len(texts) + 1):
                got = ENCODER.encode(column.slice(first, last - first))
                assert [g.tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[first:last]]
    assert not any(len(w) > token_files.LENGTH_KEPT for w in ENCODER.words)


def test_words_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 5)
    encoder = token_files.Encoder(DEFINITION)
    for i in range(30):
        text = f"one two three four w{'abc'[i % 3]} x{i} five"
        assert encoder.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(encoder.words) <= 5 and len(encoder.old_words) <= 5 + 20


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, gap in [(1, 1), (1, 10**9), (5, 1), (300, 3), (1000, 5000), (4000, 1), (257, 100000)]:
        values = np.cumsum(rng.integers(0 if n > 5 else 1, gap + 1, n))
        coded = token_files.EliasFano.of(values)
        assert (coded.all() == values).all()
        for i in {0, n - 1, n // 2, min(n - 1, 255), min(n - 1, 256)}:
            assert coded.select(i) == values[i]
        if n >= 1000:
            spent = 8 * (len(coded.low) + len(coded.high)) / n
            assert spent <= 3 + np.log2(max(1, values[-1] / n)) + 1


def written(spark, tmp_path, df, name):
    token_files.write_tokens(df, DEFINITION, f"{tmp_path}/{name}")
    return token_files.read_tokens(spark, f"{tmp_path}/{name}")


def test_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i * 7, " ".join(rng.choices(["the", "word\n", "über", "x1", "日本", " "], k=rng.choice([0, 1, 50, 400])))) for i in range(120)]
    rows += [(3, None), (4, ""), (5, "long word " * 80000)]
    shuffled = rng.sample(rows, len(rows))
    got = written(spark, tmp_path, frame(spark, shuffled), "a").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(sorted(rows))


def test_many_blocks_of_one_shard(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(3000)]
    df = frame(spark, rows).coalesce(1)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    got = written(spark, tmp_path, df, "b").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)
    blocks = spark.read.parquet(f"{tmp_path}/b")
    assert blocks.count() > 50 and blocks.filter("octet_length(high) + octet_length(low) > size(doc_ids) * 3").count() == 0


def test_single_documents_by_select(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(900)]
    token_files.write_tokens(frame(spark, rows), DEFINITION, f"{tmp_path}/e")
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 299, 300, 511, 512, 899, 899, 5000, None)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_files.read_documents(spark, f"{tmp_path}/e", wanted).collect()}
    assert got == {i: [*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for i, t in rows if i in (0, 1, 299, 300, 511, 512, 899)}


def test_odd_tables(spark, tmp_path):
    assert written(spark, tmp_path, frame(spark, []), "c").count() == 0
    odd = frame(spark, [(None, "x"), (2, "b"), (2, "b"), (2, "a")]).withColumns({c: F.lit("z") for c in ("tie", "shard", "start", "ids")})
    got = written(spark, tmp_path, odd, "d").collect()
    assert sorted(r.start for r in got) == [0, 2, 4, 6] and [r.start for r in got if r.doc_id is None] == [0]
