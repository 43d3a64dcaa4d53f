import random

import pytest
from pyspark.sql import functions as F

from driftwell.llm import url_filter
from driftwell.llm.components import components

SCHEMA = "page_id long, url string, html string"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(d + p), v, d + p) for v, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits) if fits else None


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/", "http://a.example.com/EN/",
        "http://example.com/en", "http://notexample.com/en/1", "http://com", "http://com/", "http://x.net/es/1", "http://x.net/fr/?q#f",
        "http://x.net?/fr/", "http://x.net#/fr/", "http://net/fr/", "http://x.org/a", "http://user@x.net/es/", "a://b://c.net/es/", "http://É.net/es/"]


def test_rules(spark):
    out = url_filter.judged(spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], SCHEMA)).collect()
    for r in out:
        host, path, rule = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[2], rule[1] if rule else "allow"), URLS[r.page_id]
    assert len(out) == len(URLS)


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


def test_aliases_carry_blocks_and_allows(spark):
    rows = [
        (1, "http://x.org/1", link("http://x.net/fr/1")),  # blocked by its target
        (2, "http://x.org/2#top", '<META HTTP-EQUIV="refresh" content="0; URL=/1">'),  # blocked through page 1
        (3, "http://x.org/3", link("http://y.com/3")),  # allowed by its target
        (4, "http://x.org/4", link("http://x.net/es/4")),
        (5, "http://x.org/5", "<link href='http://x.org/4' rel=canonical>" + link("http://x.com/5")),  # joins 4 and an allow
        (6, "http://x.net/fr/1", link("http://z.com/6")),  # its own rule counts
        (7, "http://q.org/7", "<!-- " + link("http://x.net/fr/1") + " -->"),
        (8, "http://q.org/8", link("") + link("#x") + link("mailto:a@b.c")),
        (9, "http://q.org/9", None), (10, "http://q.org/dir/10?a=1&b=2", link("../x")), (11, "http://q.org/11", link("http://x.net/es/4#f")),
        (1, "http://x.org/1", link("http://x.net/fr/1")),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Page 6 links the class of 1 and 2 to an allowed address, so they are allowed; its own rule still blocks itself.
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    rest = [r for r in rows if r[0] not in (5, 6)]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rest, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block"}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 500)] + [(9, 1000)], "none": [],
             "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(None, 3), (7, 7)]}[kind]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def test_empty_and_extra_columns(spark):
    assert url_filter.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "http://x.net/es/", "x")], SCHEMA).withColumns({c: F.lit("z") for c in ("host", "rule", "a", "b", "node")})
    assert url_filter.judged(odd).first().verdict == "block"
