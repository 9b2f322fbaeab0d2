import re

import numpy as np
import pyarrow as pa
import xxhash

from millrace.llm import simhash

TEXTS = ["the quick brown fox jumps over the lazy dog again and again " * 3, "The Quick brown fox jumps over the lazy dog again and again " * 3, "one two", "", None, "Éa b c d", "x " * 20000, "  \x0b\t "]


def brute(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    assert simhash.fingerprints(pa.array(TEXTS)).tolist() == [brute(t) for t in TEXTS]


def groups(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def close(f, g=None):
    g = f if g is None else g
    return [(i, j) for i in range(len(f)) for j in np.flatnonzero(simhash._apart(g ^ f[i]) <= 3).tolist()]


def test_trie_join_links_what_pairs_would():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 48, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 48, (k, 40), dtype=np.uint64)) for k in (1, 2, 3, 4) for _ in range(8)]))
    assert groups(len(f), zip(*simhash.trie_links(f), strict=True)) == groups(len(f), close(f))
    a, b = f[::2], f[1::2]
    across = list(zip(*simhash.trie_links(a, b), strict=True))
    want = [(i, len(a) + j) for i, j in close(a, b)]
    assert groups(len(f), across) == groups(len(f), want)


def test_the_walk_leaves_most_pairs_out():
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    near = f[:50] ^ np.uint64(0b1011)
    f, seen = np.unique(np.concatenate([f, near])), []
    i, j = simhash.trie_links(f, seen=seen)
    assert len(i) == 50 and (simhash._apart(f[i] ^ f[j]) == 3).all()
    walked, compared = seen[0]
    assert walked + compared < len(f) ** 2 / 2 / 5


def test_blocks_lead_every_near_pair_to_a_common_node():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for plan in (simhash.COARSE, simhash.FINE):
        orders = simhash._orders(plan)
        for x in f.tolist():
            bits = rng.choice(64, 3, replace=False).tolist()
            y = x ^ sum(1 << b for b in bits)
            lead = lambda v, o: [v >> s & ((1 << w) - 1) for s, w in o[: plan[1]]]  # noqa: B023,E731
            assert any(lead(x, o) == lead(y, o) for o in orders)
            turned = simhash._turned(np.array([x, y], np.uint64), orders[-1])
            assert simhash._apart(turned[:1] ^ turned[1:]).tolist() == [3]


def test_both_plans_link_alike(spark):
    from millrace.llm.graph import components

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    f = np.unique(np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 400), dtype=np.uint64)) for k in (1, 3, 4))]))
    df = spark.createDataFrame([(int(x), int(x)) for x in f.view(np.int64)], "fingerprint long, id long")
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    for plan in (simhash.COARSE, simhash.FINE):
        got = components(simhash.links(df, plan)).collect()
        assert groups(len(f), [(at[r["id"]], at[r["component_id"]]) for r in got]) == groups(len(f), close(f))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "k", "m"), (2, "a b c", "k", "m")], "doc_id long, text string, key string, mark string")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c", "k", "m")]


def test_components(spark):
    rng = np.random.default_rng(3)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
    rows = [(i, " ".join(rng.permutation(base * 4))) for i in range(40)] + [(100 + i, " ".join(base * 30) + f" tail{i}") for i in range(30)]
    rows += [(200, None), (201, ""), (201, ""), (202, " ".join(base * 30) + " tail0"), (None, "lonely words stand here")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, component_id int, k string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    f = np.array([brute(t) for _, t in rows], np.uint64)
    root = groups(len(rows), close(f))
    ids = [r[0] for r in rows]
    least = {g: min((ids[i] for i in range(len(rows)) if root[i] == g and ids[i] is not None), default=None) for g in set(root)}
    want = sorted(str((ids[i], format(int(f[i]), "016x"), least[root[i]])) for i in range(len(rows)))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "other words altogether here now"), (1, "a b c d")]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2]


def test_groups_without_ids_and_with_equal_ids_keep_one_each(spark):
    lone = ["alone in this group of words", "nothing like the first text at all", "a third one stands apart here", None]
    rows = [(None, t) for t in lone] + [(None, lone[0]), (7, "seven is the number of this text"), (7, "but this one has it as well"), (5, "linked by equal words"), (None, "linked by equal words")]
    got = simhash.deduplicated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string").repartition(3))
    assert got.columns == ["doc_id", "text", "k"]
    want = [(None, t) for t in lone] + [(7, "seven is the number of this text"), (7, "but this one has it as well"), (5, "linked by equal words")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_hot_blocks_are_cut_and_still_join(spark):
    rng = np.random.default_rng(4)
    f = np.unique(np.uint64(0xABCD) << np.uint64(48) | (np.uint64(1) << rng.integers(0, 40, 3000, dtype=np.uint64)) | (np.uint64(1) << rng.integers(0, 40, 3000, dtype=np.uint64)))
    old, simhash.PART = simhash.PART, 100
    try:
        df = spark.createDataFrame([(int(x), int(x)) for x in f.view(np.int64)], "fingerprint long, id long")
        from millrace.llm.graph import components

        got = components(simhash.links(df)).collect()
        at = {int(x): i for i, x in enumerate(f.view(np.int64))}
        root = groups(len(f), close(f))
        for r in got:
            assert root[at[r["id"]]] == root[at[r["component_id"]]]
        assert len({r["component_id"] for r in got}) + len(f) - len(got) == len(set(root))
    finally:
        simhash.PART = old
