import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftwell.llm import simhash
from tests.llm.helpers import frame


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(items):
    """items: {key: fingerprint}; the smallest key reachable over links of at most two bits."""
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        if (items[a] ^ items[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in items}


def corpus():
    rng = random.Random(6)
    vocabulary = [f"wört{i}" for i in range(500)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a B c"), (8, "x" * 50000), (9, "É é a"), (10, "é é A")]
    base = [rng.choices(vocabulary, k=rng.choice([3, 30, 200, 900])) for _ in range(40)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((20 + i, " ".join(words)))
    return rows


def test_fingerprints(spark):
    rows = corpus() + [(999, "Some words again " * 60000)]
    got = {r.doc_id: r["print"] & (2**64 - 1) for r in frame(spark, rows).select("doc_id", simhash.fingerprint(F.col("text")).alias("print")).collect()}
    assert got == {i: slow_print(t) for i, t in rows}


@pytest.mark.parametrize("run", [simhash.RUN, 2])
def test_groups_against_all_pairs(spark, run, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, simhash.PER_QUARTER, run))
    out = simhash.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == slow_roots({i: slow_print(t) for i, t in rows})
    assert len({r.component_id for r in out}) < 0.8 * len(rows)


@pytest.mark.parametrize("run", [simhash.RUN, 5])
def test_dense_clusters_lose_no_link(spark, run):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(60):
            near = at
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                near ^= 1 << bit
            prints.add(near)
            at = near if rng.random() < 0.3 else at
    prints |= {0, 2**64 - 1, 1, 3, 7, 2**63}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), run=run).collect()
    want = slow_roots({p: p for p in prints})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 2
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == want


def test_pivots_discard_by_coordinates():
    refs = simhash.pivots()
    prints = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    table = simhash.pivot_table(prints, refs)
    far = np.abs(table[:, None] - table[None, :]).max(axis=2)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert len(refs) == 33 and (far <= apart).all() and (far[apart > 2] > 2).mean() > 0.99


def test_odd_tables(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (2, "a b c d"), (None, "lonely words here now"), (None, "a b c d")]
    odd = frame(spark, rows).withColumns({c: F.lit("z") for c in ("print", "node", "root", "key", "count")})
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_groups(odd).collect())
    assert got == sorted([("1", "1")] * 3 + [("2", "1"), ("None", "None"), ("None", "1")])
    left = simhash.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert sorted(r.text for r in left.collect()) == ["a b c d", "lonely words here now", "q r s t u"]
