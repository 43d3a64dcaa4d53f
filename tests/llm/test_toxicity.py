import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import toxicity
from tests.llm.helpers import frame


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        text, bad = rng.choices(words, k=rng.choice([5, 40, 300])), rng.random() < 0.3
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Idiot!", "SCUM", "trash,"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    return rows, marks


def test_learns_and_predicts_held_out(spark):
    rows, marks = corpus()
    labels = spark.createDataFrame([*marks, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fitted(frame(spark, rows), labels)
    out = {r.doc_id: r for r in toxicity.scored(frame(spark, rows), model).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == dict(marks)[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert len(model[0]) < 3000  # compact
    again = toxicity.fitted(frame(spark, rows).repartition(7), labels)
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])


def test_ftrl_against_scalar_form():
    rng = random.Random(1)
    model = toxicity.Ftrl(8, 0.3, 1.0, 0.2, 0.1)
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        l1 = 0.2 if i < 8 else 0.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.1)

    for _ in range(200):
        at, y = sorted(rng.sample(range(8), 3)), rng.randrange(2)
        model.learn(np.array(at), y)
        w = {i: weight(i) for i in [*at, 8]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert [weight(i) for i in range(9)] == pytest.approx(list(model.weights(np.arange(9))))


def test_slots():
    table = toxicity.plain()
    words = lambda t: set(toxicity.slots(t.encode(), table).tolist())
    assert words("") == words(" .,! ") == set() and len(words("a")) == 1 and len(words("a b c")) == 6
    assert words("A, b!") == words("a b") and words("a b a b") >= words("a b") and words("a b") != words("b a")


def test_odd_texts_and_tables(spark):
    rows, marks = corpus(200)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fitted(frame(spark, rows), labels, sample=100)
    odd = frame(spark, [(1, None), (2, ""), (3, "scum " * 100000), (None, "a"), (1, None)]).withColumns({c: F.lit(1) for c in ("score", "place", "toxic")})
    out = toxicity.scored(odd, model).collect()
    assert len(out) == 5 and all(r.score is not None for r in out)
    none = toxicity.fitted(frame(spark, []), labels)
    assert [r.predicted for r in toxicity.scored(odd, none).collect()] == [0] * 5
    assert toxicity.scored(frame(spark, []), model).count() == 0
    assert toxicity.labelled(frame(spark, rows), labels, 50).count() <= 80
