"""Ranked lexical search against brute force."""

import collections
import math
import random
import re

import pytest

from roadlens.llm import lexical
from roadlens.session import ensure_checkpoint_dir

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    tfs = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in tfs if c), sum(sum(c.values()) for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, mine in wanted.items():
        rows = []
        for i, c in tfs:
            m = 50 + (50 * sum(c.values()) * n_docs) // length if length else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in mine if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def tables():
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gam_ma", "x1", "1x", "été", "ÉTÉ", "日本", "a", "b", "ab", "aba", "no\xa0break", "it's", *map(str, range(30))]
    docs = [(i, rnd.choice([" ", "\n", "-", ", "]).join(rnd.choice(words) for _ in range(rnd.randrange(0, 40)))) for i in range(160)]
    docs += [(200, None), (201, ""), (202, "--- _"), (203, "aba " * 20_000), (None, "alpha beta"), (None, "alpha beta")]
    docs += [(300 + i, "same alpha text") for i in range(70)] + [(300, "same alpha text")]  # ties and a repeated row
    items = [(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(25)]
    items += [(5, "alpha more"), (90, None), (91, ""), (92, "unseen"), (93, "same alpha"), (None, "beta 1x"), (94, "aba ab a b")]
    return docs, items


@pytest.mark.parametrize("top,slice_terms", [(50, lexical.SLICE_TERMS), (3, 60)])
def test_ranks(spark, top, slice_terms, monkeypatch):
    ensure_checkpoint_dir(spark)
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in lexical.search(d, q, top=top, slice_terms=slice_terms).collect()), key=str)
    assert got == brute(docs, items, top)


def test_best_of_many_offers(monkeypatch):
    import numpy as np
    monkeypatch.setattr(lexical, "_HELD", 10)
    rnd = np.random.default_rng(2)
    item, score, doc = rnd.integers(0, 4, 3000), rnd.integers(0, 50, 3000), rnd.permutation(3000)
    best = lexical.Best(4, 5)
    for k in range(0, 3000, 100):
        best.offer(item[k:k + 100], score[k:k + 100], doc[k:k + 100], np.zeros(100, dtype=bool))
    got = sorted(zip(*(x.tolist() for x in best.trim()[:3])))
    every = [sorted((-s, d) for i, s, d in zip(item, score, doc) if i == k and s > 0)[:5] for k in range(4)]
    assert got == sorted((k, -s, d) for k, rows in enumerate(every) for s, d in rows)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.search(d, q)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
