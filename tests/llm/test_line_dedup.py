import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import line_dedup
from tests.llm.helpers import frame


def key(line):
    stripped = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute(rows, threshold=10, least=1):
    cut = [(t or "").split("\n") for _, t in rows]
    seen = Counter(k for lines in cut for k in {key(x) for x in lines} if len(k) >= least)
    out = []
    for (i, _), lines in zip(rows, cut):
        kept = [x for x in lines if seen[key(x)] < threshold]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    lines = [f"line {i} é🙂" for i in range(40)] + ["", "  ", "Share this!", " SHARE this!\t", "É", "é", "\x0b\x0c", "a\r"]
    weights = [1] * 40 + [6] * 8
    rows = [(i, "\n".join(rng.choices(lines, weights, k=rng.choice([0, 1, 3, 9])))) for i in range(150)]
    rows += [(200, None), (201, ""), (201, ""), (None, "Share this!"), (202, "\n\n"), (203, "share this!\n" * 5000)]
    return rows + [(204, "x" * 300_000 + "\nshare this!"), *((300 + i, "copy\nof a text") for i in range(9))]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [line_dedup.LIMIT, 0])
def test_against_brute_force(spark, limit):
    rows = cases()
    assert rows_of(line_dedup.dedup_lines(frame(spark, rows), limit=limit)) == brute(rows)


@pytest.mark.parametrize("limit", [line_dedup.LIMIT, 0])
def test_other_thresholds(spark, limit):
    rows = cases()
    found = line_dedup.dedup_lines(frame(spark, rows), threshold=3, least=4, limit=limit)
    assert rows_of(found) == brute(rows, 3, 4)
    assert rows_of(line_dedup.dedup_lines(frame(spark, rows), threshold=400, limit=limit)) == brute(rows, 400)


@pytest.mark.parametrize("limit", [line_dedup.LIMIT, 0])
def test_many_shards_give_the_same(spark, limit):
    rows = cases()
    docs = frame(spark, rows)
    index = line_dedup.line_index(docs, keys=5)
    assert index.shards > 5 and index.rows.count() > 5
    assert rows_of(line_dedup.dedup_lines(docs, limit=limit, index=index)) == brute(rows)


@pytest.mark.parametrize("limit", [line_dedup.LIMIT, 0])
def test_lines_of_other_documents_only_go_if_the_index_says_so(spark, limit):
    index = line_dedup.line_index(frame(spark, [(i, "Footer\nHeader") for i in range(10)] + [(99, "rare")]))
    found = line_dedup.dedup_lines(frame(spark, [(1, "new\nfooter \nrare"), (2, "newer"), (3, "HEADER")]), limit=limit, index=index)
    assert rows_of(found) == [(1, 3, 1, "new\nrare"), (2, 1, 0, "newer"), (3, 1, 1, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_numbers_are_a_permutation(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    high[: n // 3] = 7  # equal first halves are told apart by the second
    hashed = line_dedup.PerfectHash.over(high, low)
    assert sorted(hashed.number(high, low).tolist()) == list(range(n))
    assert 64 * len(hashed.words) <= 4.2 * n + 700


def test_counts_end_at_what_the_threshold_needs():
    high, low, n = np.arange(3, dtype=np.uint64), np.array([1 << 40, 2 << 40, 3 << 40], np.uint64), np.array([5, 10, 1 << 40])
    shard = line_dedup.Shard(line_dedup.Shard.laid(high, low, n, 10))
    assert shard.count(high, low).tolist() == [5, 10, 255]
    assert shard.count(high, low + np.uint64(9 << 50)).tolist() == [0, 0, 0]
    wide = line_dedup.Shard(line_dedup.Shard.laid(high, low, n, 70_000))
    assert wide.count(high, low).tolist() == [5, 10, (1 << 32) - 1]


def test_a_hot_text_and_a_hot_line(spark):
    rows = [(i, "same text\nsame line" if i % 3 else f"own {i}\nsame line") for i in range(6000)]
    for limit in (line_dedup.LIMIT, 0):
        assert rows_of(line_dedup.dedup_lines(frame(spark, rows), limit=limit)) == brute(rows)


@pytest.mark.parametrize("limit", [line_dedup.LIMIT, -1])
def test_empty_table_and_clashing_names(spark, limit):
    assert line_dedup.dedup_lines(frame(spark, []), limit=limit).count() == 0
    odd = frame(spark, [(i, "a\nb") for i in range(10)]).withColumns({c: F.lit("z") for c in ("block", "high", "shard", "kept", "gone", "TEXT2")})
    assert rows_of(line_dedup.dedup_lines(odd, limit=limit)) == brute([(i, "a\nb") for i in range(10)])
    words = spark.createDataFrame([("x", "a")], "doc_id string, text string")
    assert rows_of(line_dedup.dedup_lines(words, limit=limit)) == [("x", 1, 0, "a")]


def test_query_reads_whole_texts(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    found = line_dedup.dedup_lines(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert rows_of(found) == brute(rows)
    assert line_dedup.op11_line_dedup(spark, tiny).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
