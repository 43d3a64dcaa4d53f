import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftwell.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    data = f"{len(role.encode())}:".encode() + role.encode() + text.encode()
    return hashlib.sha256(data).hexdigest()[:32]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, code(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    name = {k: min(v) for k, v in members.items()}
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += own
    ends = {k: ",".join(str(c) for c in sorted(v) if len(sequences[c]) == len(k)) for k, v in members.items()}
    return sorted(((name[k], len(k), name[k[:-1]] if k else None, len(members[k]), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k in members), key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df))).drop("turn")
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def talks(seed, n, longest, kinds):
    rng = random.Random(seed)
    says = [("user", f"text {i} é🙂") for i in range(kinds)] + [("tool", ""), (None, None), ("user", "")]
    return [(c, t, *rng.choice(says)) for c in range(-n // 3, n) for t in range(rng.choice([0, 1, 2, longest // 2, longest]))]


@pytest.mark.parametrize(("n", "longest", "kinds"), [(40, 9, 1), (30, 21, 2), (60, 3, 5), (12, 70, 1)])
def test_against_brute_force(spark, n, longest, kinds):
    rows = talks(n, n, longest, kinds)
    assert found(spark, rows) == brute(rebuilt(rows))


def test_turns_in_order_of_number_null_first_and_ties_by_digest(spark):
    rows = [(7, None, "a", "x"), (7, 2, "b", "y"), (7, 2, "c", "z"), (7, 1, None, None), (7, 2, "b", "y"), (None, 1, "a", "b"), (None, None, None, None)]
    assert found(spark, rows) == brute(rebuilt(rows))
    codes = [r.turn[:32] for r in prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()]
    assert codes[:2] == [code("a", "x"), code("", "")] and codes[2:] == sorted([code("b", "y"), code("c", "z"), code("b", "y")])


def test_role_and_text_do_not_run_together(spark):
    rows = [(10, 1, "ab", "c"), (11, 1, "a", "bc"), (13, 1, "", "abc"), (14, 1, "abc", "")]
    sequences = {c: [(role, text)] for c, _, role, text in rows}
    df = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    nodes = prefix_trie.prefix_trie(df.select("conv_id").distinct(), df).drop("turn")
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == brute(sequences)


def test_members_without_turns(spark):
    # 13: h = 8 and no conversation 10 before it, so nothing is left.
    without = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8][:4]
    rows = [(c, 1, "user", "hello") for c in without]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert len(found(spark, rows)) == 1
    some = rows + [(without[0] - without[0] % 5, 1, "user", "hi")]
    assert found(spark, some) == brute(rebuilt(some))


def test_many_copies_and_one_long_conversation(spark):
    rows = [(5 * c, t, "user", f"same {t}") for c in range(2000) for t in range(3)] + [(1, t, "u", str(t % 3)) for t in range(700)]
    assert found(spark, rows) == brute(rebuilt(rows))


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
    rows = talks(3, 10, 5, 2)
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("at", "code", "pos", "name", "ends", "base", "TEXT2")})
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(odd))).drop("turn")
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == brute(rebuilt(rows))


def test_every_pass_only_has_a_row_per_piece(spark):
    """2,000 equal conversations of eight turns are one piece on every height."""
    df = spark.createDataFrame([(c, t, "u", str(t)) for c in range(200) for t in range(8)], SCHEMA)
    turns = prefix_trie._turn_windows(prefix_trie.turns_of(df))
    levels = prefix_trie._windows(turns, 3)
    assert [level.select("at", "code").distinct().count() for level in levels] == [8, 4, 2, 1]
    whole = levels[3].groupBy(F.col("code").alias("ends")).agg(F.min("conv_id").alias("name"), F.count("*").alias("n"))
    pieces = whole.select(F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("tag"), F.col("ends").alias("code"), "name", "n", "ends")
    for height, rows in ((3, 2), (2, 4), (1, 8)):
        pieces, _ = prefix_trie._halved(pieces, levels[height], height)
        assert pieces.count() == rows and {r.n for r in pieces.collect()} == {200}


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = prefix_trie.op13_prefix_trie(spark, tiny)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rebuilt(rows))
    assert set(dict(out.dtypes).values()) == {"bigint", "string"}
