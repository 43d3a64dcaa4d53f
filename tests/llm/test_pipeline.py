import random

import corpus_pipeline
import duckdb
from driftwell.llm import mixing
from tests.llm import test_simhash, test_word_bpe
from tests.llm.helpers import frame

WORDS = {"en": "the of and water house thing with for from this", "de": "der die und wasser haus über straße für mit nicht"}


def corpus():
    rng = random.Random(13)
    rows = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.choice([1, 2, 40, 300]))), lang, rng.choice(["a", "b", None])))
    for i in range(150, 220):  # exact and near copies
        _, text, lang, source = rng.choice(rows)
        words = text.split()
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(WORDS[lang].split())
        rows.append((i, " ".join(words), lang, source))
    return rows + [(300, None, "en", "a"), (301, "", "en", "a"), (302, "123 %%% 456", "en", "b"), (303, "!", None, None)]


def brute(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [r for r in rows if r[0] == max(o[0] for o in rows if o[1] == r[1])]
    roots = test_simhash.slow_roots({r[0]: test_simhash.slow_print(r[1]) for r in rows})
    rows = [r for r in rows if roots[r[0]] == r[0]]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?,?,?,?)", rows)
    rel = con.execute(f"select doc_id, case when size > 0 then taken // size else 0 end from ({mixing.SQL})")
    copies = dict(rel.fetchall())
    out = []
    for r in rows:
        ids = [int(i) for i in test_word_bpe.brute(r[1])[1].split()]
        out += [(r[0], len(ids), ids)] * copies[r[0]]
    return sorted(out)


def test_run_against_brute_force(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in out) == brute(corpus())
    assert 30 < len(out)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = frame(spark, corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
