import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import quality
from tests.llm.helpers import frame


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def good(rng, n=None):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) + rng.choice(["", "", "", ".\n"]) for _ in range(n or int(60 + rng.expovariate(1 / 150))))


def corpus(n=260, sources=("s", "t")):
    rng = random.Random(11)
    rows = [(i, good(rng), "en", sources[i % len(sources)]) for i in range(n)]
    junk = []
    for i in range(12):
        words = good(rng).split()
        junk.append((1000 + i, " ".join(w + "%%%" for w in words) if i % 2 else " | ".join(words * 1) + "\n" + "\n".join(["buy now ok"] * 9), "en", sources[0]))
    return rows, junk


def test_counts(spark):
    rng = random.Random(10)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\nx\n\n \nx\r\nx", "é🙂 #*$%&|<> é", "a b c d a b c e a b c",
             "w " * 20000, good(rng, 9000), " ".join(["a b", "c", "d"][rng.randrange(3)] for _ in range(300)), "\x0b\x0c\x85\xa0 x", "a\x00b c"]
    texts += [" ".join(rng.choices("pqrstuvw", k=rng.randrange(60))) for _ in range(60)]
    got = quality.counted(frame(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert tuple(r)[3:] == slow(texts[r.doc_id]), texts[r.doc_id]


def test_outliers_go_and_clean_documents_stay(spark):
    rows, junk = corpus()
    out = {r.doc_id: r for r in quality.judged(frame(spark, rows + junk), least=50).collect()}
    assert len(out) == len(rows) + len(junk)
    assert not any(out[r[0]].kept for r in junk)
    assert sum(out[r[0]].kept for r in rows) >= 0.99 * sum(not out[r[0]].base_failed for r in rows)
    assert all(r.kept is not None and not (r.base_failed and r.kept) for r in out.values())


def test_steps_against_numpy_and_falling_determinant(spark):
    rows, junk = corpus(sources=("s",))
    df = quality.counted(frame(spark, rows + junk)).filter("not base_failed").select("*", *quality.vector())
    df = quality.grouped(df, 10).select(*quality.KEYS, *(f"x{i}" for i in range(quality.P))).cache()
    x = np.array(df.select(*(f"x{i}" for i in range(quality.P))).collect(), float)
    floor = np.diag([(f * 1000) ** 2 for f in quality.FLOORS])
    mean, cov = x.mean(0), np.cov(x.T, bias=True) + floor
    est = quality.kept_once(quality.starting(df))
    first = est.filter("start = 0").first()
    assert first.logdet == pytest.approx(np.linalg.slogdet(cov)[1] / 2)
    for _ in range(4):
        diff = x - mean
        d2 = (diff @ np.linalg.inv(cov) * diff).sum(1)
        bins = np.floor(np.log(d2 + 1e-3) * quality.BINS)
        order = np.sort(bins)
        near = x[bins <= order[int(np.ceil(len(x) * quality.SHARE)) - 1]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
        est = quality.kept_once(quality.concentrated(df, est))
    row = est.filter("start = 0").first()
    assert row.logdet == pytest.approx(np.linalg.slogdet(cov)[1] / 2, rel=1e-6)
    assert [row[f"m{i}"] for i in range(quality.P)] == pytest.approx(mean.tolist())
    assert row.logdet < first.logdet


def test_small_groups_pool_and_odd_tables(spark):
    assert quality.judged(frame(spark, [])).count() == 0
    rng = random.Random(12)
    rows = [(i, good(rng), None, None if i % 3 else "x") for i in range(9)] + [(100, None, "de", "y"), (None, good(rng), "de", "y")]
    odd = frame(spark, rows).withColumns({c: F.lit("z") for c in ("words", "kept", "part", "x0", "n", "bin")})
    out = quality.judged(odd).collect()
    assert len(out) == 11 and all(r.kept == (not r.base_failed) and r.distance is None for r in out)
    pooled = [(i, good(rng), "en", f"s{i % 40}") for i in range(200)]
    out = quality.judged(frame(spark, pooled)).collect()
    assert sum(r.distance is not None for r in out) == sum(not r.base_failed for r in out)
