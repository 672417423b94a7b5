"""Ranked search over treaps against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm import ranking
from gaugeworks.llm.queries import ORACLE, op12_lexical_search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(t):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words_of(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def test_terms():
    for t in ["", "a-b_c ÄÖ İ x1y2\x7f\x80é", "ABC aBc", "\t\n\x0b\x1c1", "日本, 語!"]:
        assert [w.decode() for w in ranking.terms(t)] == words_of(t)
    assert ranking.terms(None) == []


def test_treap_order_and_ranges():
    rng = np.random.default_rng(2)
    places = np.sort(rng.choice(1000, 200, replace=False))
    t = ranking.Treap(places, rng.integers(1, 9, 200))
    for k in range(200):
        for child, side in ((t.left[k], -1), (t.right[k], 1)):
            if child >= 0:
                assert t.impact[child] <= t.impact[k] and (t.places[child] - t.places[k]) * side > 0
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, 1001, 2).tolist())
        inside = (places >= lo) & (places < hi)
        v = t.within(t.root, lo, hi)
        assert (v < 0) == (not inside.any())
        if v >= 0:
            assert inside[v] and t.impact[v] == t.adds[inside].max()


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_shard_search_is_exact_and_prunes(leaf):
    rng = np.random.default_rng(3)
    n = 3000
    query = []
    for w in (5, 90, 700, 700):
        places = np.sort(rng.choice(n, 600, replace=False))
        query.append((w, ranking.Treap(places, (1000 / rng.integers(1, 400, 600)).astype(np.int64) + 1)))
    total = np.zeros(n, np.int64)
    for w, t in query:
        total[t.at] += w * t.adds
    best = ranking.Best(10)
    scored = ranking.search_shard(query, list(range(n)), best, leaf)
    want = sorted(((int(-s), i) for i, s in enumerate(total) if s > 0))[:10]
    assert sorted((-s, i) for s, i in best.rows()) == want
    if leaf == 1:
        assert scored < n // 3


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 40, "item_bytes": 400, "term_bytes": 0, "leaf": 2}])
def test_tables_with_odd_rows(spark, words, sizes):
    rng = random.Random(1)
    docs = [(i, words(rng.randrange(1, 30))) for i in range(150)]
    docs += [(7, docs[3][1]), (8, docs[3][1]), (None, docs[3][1]), (None, docs[4][1]), (200, None), (201, ""), (202, " ,.- "), (203, "ban ban " * 3000 + "Ürz"), (-4, docs[3][1])]
    items = [("a", docs[3][1]), ("b", "BAN ban ken. unheard"), ("b", "kesa"), (None, "lin"), ("c", None), ("d", "?"), ("e", "üRZ Ürz ürz")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
    got = ranking.search(d, q, k=9, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 9)
    assert ranking.search(d.limit(0), q).count() == 0
    assert ranking.search(d, q.limit(0)).count() == 0


def test_query_equals_sql(same):
    same(op12_lexical_search, ORACLE["op12_lexical_search"])
