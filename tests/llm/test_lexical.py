"""Ranked search against scores of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from parity import both, views

from millrace.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wants in asked.items():
        scores = []
        for i, c in found:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wants.items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, item long, term string, n long").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in lexical.ranked(d, q, **more).collect())


def made(n, seed=3, vocabulary=60):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 40)) % vocabulary)) for i in rng.permutation(n)]


def test_equals_brute_force(spark):
    docs = [*made(900), (None, "w1 w2 w3"), (5000, None), (5001, ""), (5002, "W1,W2;Ärger ÄRGER ärger\x7fw3_w4"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (5003, "w1 " * 30_000), (5004, "\x00-\x1f ... __")]
    items = [(1, "w1 w2 w3 w2"), (2, "ärger w59 w58 w57"), (3, None), (4, "nothing known"), (None, "w1"), (5, "w1"), (6, "W9 w10"), (6, "w11"), (7, " ".join(f"w{i}" for i in range(60)))]
    assert run(spark, docs, items) == brute(docs, items)


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(3000)] + [(i, "other words") for i in range(3000, 6000)]
    items = [(1, "same words"), (2, "other"), (3, "here other")]
    assert run(spark, docs, items, 5) == brute(docs, items)


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 7)
    docs, items = made(300), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(20)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a b"), (2, "c")], [])
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_leave_ranges_closed():
    rng = np.random.default_rng(1)
    n, vocabulary = 4096, 50
    place = np.repeat(np.arange(n), 5)
    term = rng.integers(0, vocabulary, n * 5)
    pair = np.unique(place * vocabulary + term)
    place, term = pair // vocabulary, pair % vocabulary
    score = rng.integers(1, 20, len(pair))
    score[place // 256 == 3] += 100
    tree = lexical.Tree(np.arange(n), place, term, score, vocabulary)
    best: list = []
    opened = tree.search(np.array([1, 2, 3]), np.array([1, 2, 1]), best, 10, 1)
    sums = np.zeros(n, np.int64)
    for t, times in ((1, 1), (2, 2), (3, 1)):
        np.add.at(sums, place[term == t], score[term == t] * times)
    assert sorted((-s, -d) for s, d in best) == sorted((-int(s), i) for i, s in enumerate(sums))[:10]
    assert opened < (1 + 16 + 256) / 4
    assert tree.search(np.array([1]), np.array([1]), [], 10, 10**9) == 0


@pytest.mark.parametrize("name", sorted(lexical.ORACLE))
def test_same_rows_as_sql(spark, data, name):
    mine, theirs = both(spark, views(data), lexical.QUERIES[name], lexical.ORACLE[name], data)
    assert mine == theirs
