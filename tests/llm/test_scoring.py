import collections
import math
import re
import zlib

import numpy as np
import pytest

from millrace.llm import scoring, trie

ROWS = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefgh"), 20)) + (" Zeta" if i % 5 == 0 else "")) for i in range(60)]
ROWS += [(100, None), (101, ""), (None, "a b c"), (5, "a A b"), (5, "a A b"), (102, "É  x  y\x0bz"), (103, "a " * 30000)]


def words(t):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]


def brute(rows):
    """Scores by dictionaries over all training rows."""
    c, b, follow, n = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2:
            continue
        s = ["<s>", *words(t), "</s>"]
        for x, y in zip(s, s[1:], strict=False):
            c[y] += 1
            b[x, y] += 1
            follow[x].add(y)
            n[x] += 1
    total, types = sum(c.values()), len(c)
    one, two = (sum(v == k for v in c.values()) for k in (1, 2))
    cut = min(0.9, max(0.1, one / (one + 2 * two)))
    out = []
    for i, t in rows:
        s = ["<s>", *words(t), "</s>"]
        p = base = known = 0
        for x, y in zip(s, s[1:], strict=False):
            uni = (c[y] - cut) / total if c[y] else cut * types / total
            p += math.log10((max(b[x, y] - 0.75, 0) / n[x] if b[x, y] else 0) + (0.75 * len(follow[x]) / n[x] if n[x] else 1) * uni)
            base += math.log10((c[y] + 1) / (total + types + 1))
            known += c[y] > 0
        out.append((-1 if i is None else i, len(s) - 1, known, total, base, p))
    return sorted(out)


def test_scores_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in ROWS], "doc_id long, text string, score string, block double").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scoring.score(df).collect())
    want = brute(ROWS)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=2e-3)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scoring.score(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (100, 120), (5000, 10**9), (3000, 3100)):
        v = np.sort(rng.choice(top, n, replace=False))
        ef = trie.EliasFano.coded(v, top)
        x = np.unique(np.concatenate([v, rng.integers(0, top, 2000)]))
        assert (ef.get(np.arange(n)) == v).all()
        at, hit = ef.search(x, np.zeros(len(x), int), np.full(len(x), n))
        assert (hit == np.isin(x, v)).all() and (at[hit] == np.searchsorted(v, x[hit])).all()
        # only what lies between the two places given is found
        lo = rng.integers(0, n, len(x))
        hi = np.minimum(n, lo + rng.integers(0, 50, len(x)))
        at, hit = ef.search(x, lo, hi)
        place = np.searchsorted(v, x)
        assert (hit == (np.isin(x, v) & (place >= lo) & (place < hi))).all() and (at[hit] == place[hit]).all()
        assert len(ef.low) * 64 <= n * ef.low_bits + 192


def test_trie_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 50 * 1000, 4000))
    c, w = pairs // 1000, pairs % 1000
    t = trie.NgramTrie.built(50, 1000, c, w, -rng.random(len(c)), -rng.random(50))
    (tmp_path / "t").write_bytes(t.to_bytes())
    m = trie.NgramTrie.mapped(str(tmp_path / "t"))
    ask = np.arange(50 * 1000)
    got = m.find(ask // 1000, ask % 1000)
    assert ((got != 255) == np.isin(ask, pairs)).all() and (m.find(c, w) == t.p).all()


def test_quantised_means_keep_the_order():
    v = np.random.default_rng(3).normal(size=5000)
    code, book = trie.quantised(v)
    assert np.abs(book[code] - v).max() < 1 and (np.diff(book) > 0).all()
