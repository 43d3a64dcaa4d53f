import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell.llm import mixing
from tests.llm.helpers import frame


def rows(n=400, sources=("a", "b", "c", "é", None, ""), seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), "en", rng.choice(sources)) for i in range(n)]
    return out + [(n, None, "en", "a"), (n + 1, "", "en", "zero"), (n + 2, " \t ", None, "zero"), (n + 3, "w " * 5000, "en", "a")]


def water(sizes, weights, whole):
    """Targets by plain repetition: who is above its ceiling stops there, the rest share again."""
    capped = {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        level = (whole - sum(capped.values())) / max(sum(rest.values()), 1e-9)
        over = [s for s, w in rest.items() if level * w > 2 * sizes[s]]
        if not over:
            return capped | {s: level * w for s, w in rest.items()}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_against_sql_and_brute_targets(spark):
    data = rows()
    out = mixing.mixed(frame(spark, data)).collect()
    sizes = defaultdict(int)
    for _, text, _, source in data:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    got, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(got[s] - want[s]) <= largest[s] / 2 + 1e-6

    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?,?,?,?)", data)
    rel = con.execute(mixing.SQL)
    names = [c[0] for c in rel.description]
    sql = sorted(tuple(dict(zip(names, r))[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in rel.fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out) == sql


def test_small_bins_give_the_same_draw(spark):
    df = frame(spark, rows(3000, ("a",)))
    draw = lambda n: sorted(tuple(r) for r in mixing.mixed(df, rows_per_bin=n).collect())
    assert draw(1) == draw(10**6)


def test_longer_documents_are_drawn_more_often(spark):
    df = frame(spark, [(i, "w " * (4 if i % 2 else 200), "en", "a" if i % 50 else "b") for i in range(4000)])
    out = mixing.mixed(df, weights=(1, 1)).filter("source = 'a'").groupBy("size").agg(F.avg("copies").alias("m")).collect()
    by = {r.size: r.m for r in out}
    assert by[200] > by[4] > 0


def test_odd_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    odd = frame(spark, rows(50) + [(7, "w w", "en", "a")] * 5 + [(None, "w", None, None)]).withColumns(
        {c: F.lit(1) for c in ("size", "target", "bin", "rank", "open")})
    out = mixing.mixed(odd)
    assert out.count() == odd.count()
    copies = mixing.stage(spark, odd, "")
    assert copies.columns == odd.columns
    words = lambda df: df.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))).first()[0]
    assert words(copies) == out.select(F.sum("taken")).first()[0]
