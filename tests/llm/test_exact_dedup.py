import hashlib
import random

from pyspark.sql import functions as F

from driftwell.llm import exact_dedup
from tests.llm.helpers import frame

LONG = "Alpha beta. Gamma delta!\n" * 3000


def cases():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (5, "A"), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "x" + LONG),
            (10, "a "), (11, "é" * 5000), (12, "é" * 5000), (None, "a"), (4, "a"), (13, "🙂" * 300), (14, "\r\n\n")]
    words = ["one", "two.", "three\n", "four"]
    rows += [(20 + i, " ".join(rng.choices(words, k=rng.choice([1, 2, 300])))) for i in range(60)]
    return rows


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("row").collect()), key=str)


def test_against_brute_force(spark):
    rows = cases()
    assert rows_of(exact_dedup.exact_groups(frame(spark, rows))) == brute(rows)


def test_clashing_hashes_are_told_apart(spark):
    rows = cases()
    weak = lambda c: F.length(c).cast("long") % 3
    assert rows_of(exact_dedup.exact_groups(frame(spark, rows), weak)) == brute(rows)


def test_chunks_give_the_text_again(spark):
    df = frame(spark, cases()).filter("text is not null")
    cut = exact_dedup.chunks(F.col("text"))
    assert df.filter(F.array_join(cut, "") != F.col("text")).count() == 0
    assert df.select(F.max(F.size(cut))).first()[0] > 100


def test_empty_table_and_clashing_names(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    odd = frame(spark, [(1, "a"), (2, "a")]).withColumns({c: F.lit("z") for c in ("row", "recipe", "hash", "chunk", "kept")})
    assert rows_of(exact_dedup.exact_groups(odd)) == brute([(1, "a"), (2, "a")])
    assert exact_dedup.stage(spark, odd, "").columns == odd.columns


def test_stage_keeps_one_row_of_each_text(spark):
    rows = cases()
    left = exact_dedup.stage(spark, frame(spark, rows), "").collect()
    assert sorted((r.text or "") for r in left) == sorted({t or "" for _, t in rows})
