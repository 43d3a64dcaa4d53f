import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import language
from tests.llm.helpers import frame

WORDS = {"en": "the of and water house thing with", "de": "der die und wasser haus über straße", "fr": "le la et eau maison être où"}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[l].split(), k=rng.choice([8, 20, 200]))), l, "s") for i in range(n) for l in [rng.choice(list(WORDS))]]


class Slow:
    """The same statistic byte by byte from dicts."""

    def __init__(self, texts, floor):
        grams = Counter()
        for t in texts:
            b = b"   " + t
            grams.update(b[i:i + 4] for i in range(len(b) - 3))
        # Texts of a task are counted end to end, three spaces apart.
        total = sum(grams.values())
        self.next = {}
        for g, n in grams.items():
            if n >= floor * total:
                for k in range(4):
                    self.next.setdefault(g[3 - k:3], Counter())[g[3]] += n

    def bits(self, text):
        b, total = b"   " + text, 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                seen = self.next.get(b[i - k:i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    total -= math.log2(seen[b[i]] / whole)
                    break
                total -= math.log2(len(seen) / whole)
            else:
                total += 8
        return total


def test_code_lengths_against_byte_by_byte(spark):
    rows = corpus(60)
    # One text per task, so that no grams run across texts.
    counts = {}
    table = language.folded()
    for lang in WORDS:
        texts = [t.lower().encode().translate(table) for _, t, l, _ in rows if l == lang]
        slow = Slow(texts, 0)
        grams = {}
        for ctx, after in slow.next.items():
            if len(ctx) == 3:
                for byte, n in after.items():
                    grams[int.from_bytes(ctx + bytes([byte]), "big")] = n
        keys = sorted(grams)
        import numpy as np
        counts[lang] = (np.array(keys, dtype=np.int64), np.array([grams[k] for k in keys]))
        counts[lang, "slow"] = slow
    trees = language.Trees({k: v for k, v in counts.items() if isinstance(k, str)})
    probes = [b"the house", b"", b"x", "straße über".encode(), b"zzzz qqqq", "日本".encode(), b"w" * 5000]
    got = trees.bits(probes)
    for i, p in enumerate(probes):
        for j, lang in enumerate(trees.languages):
            assert got[i, j] == pytest.approx(counts[lang, "slow"].bits(p), rel=1e-4), (p, lang)


def test_counts_cover_all_rows(spark):
    rows = corpus(40) + [(99, "the the", "en", "s")] * 3
    got = language.gram_counts(frame(spark, rows).select("lang", "text").repartition(5)).filter("lang = 'en'")
    n = got.agg(F.sum("n")).first()[0]
    letters = sum(len(t) for _, t, l, _ in rows if l == "en")
    assert n >= letters


def test_predicts_held_out(spark):
    out = language.identified(frame(spark, corpus()), language.trained_on(frame(spark, corpus(200, 5)))).collect()
    truth = {r[0]: r[2] for r in corpus()}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts_and_tables(spark):
    trees = language.trained_on(frame(spark, corpus()))
    odd = [(1, None), (2, ""), (3, "123 %%%"), (4, "é"), (5, "the " * 200000), (6, "日本語", None, "s"), (None, "the house"), (6, "日本語", None, "s")]
    got = language.identified(frame(spark, odd).withColumns({c: F.lit("x") for c in ("lang_pred", "score", "found")}), trees).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by[i].score for i in (1, 2, 3)] == [0, 0, 0]
    assert by[5].lang_pred == by[None].lang_pred == "en" and by[4].lang_pred != "und" and len(got) == 8
    none = language.trained_on(frame(spark, []))
    assert language.identified(frame(spark, [(1, "the")]), none).first().lang_pred == "und"
    assert language.identified(frame(spark, []), trees).count() == 0
    left = language.stage(spark, frame(spark, corpus() + odd), "")
    assert left.columns == frame(spark, []).columns and left.filter("text = '123 %%%' or text = '' or text = '日本語'").count() == 0
    assert left.count() >= 240


def test_any_number_of_languages(spark, monkeypatch):
    stray = [(1000 + i, f"stray text number {chr(97 + i % 26)}{chr(97 + i // 26)}", f"x-{i}", "s") for i in range(150)]
    monkeypatch.setattr(language, "WAITING", 500)
    trees = language.learned(frame(spark, corpus() + stray).select("lang", "text"))
    assert len(trees.languages) == 153 and trees.languages == sorted(trees.languages)
    out = language.identified(frame(spark, corpus()), trees).collect()
    truth = {r[0]: r[2] for r in corpus()}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    # Groups of any size come to what all languages at once come to.
    texts = [t.encode().translate(language.folded()) for _, t, _, _ in corpus()[:20] + stray[::9]] + [b"", b"x"]
    bits = trees.bits(texts)
    length = np.array([max(1, len(t)) for t in texts])
    scaled = bits * (np.minimum(length, language.CERTAIN) / length)[:, None]
    for group in (1, 7, 200):
        chosen, score, rate = trees.best(texts, group)
        assert (chosen == bits.argmin(axis=1)).all() and rate == pytest.approx(bits.min(axis=1) / length)
        assert score == pytest.approx(1 / np.exp2(scaled.min(axis=1, keepdims=True) - scaled).sum(axis=1))


def test_trees_hold_only_what_their_language_has():
    rng = np.random.default_rng(4)
    counts = {f"l{i}": (np.unique(rng.integers(0, 1 << 32, 300)), np.arange(1, 301)) for i in range(200)}
    trees = language.Trees({k: (g, n[:len(g)]) for k, (g, n) in counts.items()})
    held = sum(a.nbytes for t in trees.trees for order in t.orders for a in order if a.ndim) + sum(t.single.nbytes for t in trees.trees)
    assert held < 200 * (300 * 3 * 24 + 256 * 8)


@pytest.mark.parametrize("floor", [0.004, 0.9])
def test_shorter_contexts_keep_all_counts(spark, floor):
    rng = random.Random(8)
    texts = {"en": " ".join(rng.choices(WORDS["en"].split(), k=90)), "zh": "".join(chr(0x4E00 + int(rng.paretovariate(0.5)) % 9000) for _ in range(400))}
    trees = language.learned(frame(spark, [(i, t, lang, "s") for i, (lang, t) in enumerate(texts.items())]).select("lang", "text"), floor)
    probes = [t[:200].encode() for t in texts.values()] + [b"the thing", "日本語の文".encode()]
    got = trees.bits(probes)
    for at, lang in enumerate(trees.languages):
        slow, pruned = Slow([texts[lang].encode()], 0), Slow([texts[lang].encode()], floor)
        slow.next = {c: after for c, after in slow.next.items() if len(c) < 3} | {c: after for c, after in pruned.next.items() if len(c) == 3}
        assert [got[i, at] for i in range(len(probes))] == pytest.approx([slow.bits(p) for p in probes], rel=1e-6)
    assert trees.languages == ["en", "zh"]
