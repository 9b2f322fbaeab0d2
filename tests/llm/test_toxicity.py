import zlib

import numpy as np

from millrace.llm import toxicity

BAD = ["grumble", "snarling", "vileness", "spitefulx"]


def corpus(n=1200):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(plain, rng.integers(20, 200)).tolist()
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w.insert(int(rng.integers(len(w))), str(rng.choice(BAD)))
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r for r in toxicity.score(d, model, ["doc_id"]).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: t for i, _, t in labels}
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert np.mean([got[i]["predicted"] for i in held if truth[i]]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert np.array_equal(a.weights, b.weights) and all(np.array_equal(x, y) for p, q in zip(a.levels, b.levels, strict=True) for x, y in zip(p, q, strict=True))


def test_odd_rows(spark):
    docs, labels = corpus(300)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [(1, None, "a", 5), (2, "", "a", 5), (2, "", "a", 5), (None, "x " * 50000, "b", 6), (3, "!!! ???", None, None)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, value string, score int"), model)
    assert out.columns == ["doc_id", "text", "value", "score", "predicted"]
    got = out.collect()
    assert len(got) == 5 and len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1 and all(r["predicted"] == 0 for r in got)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    rows = spark.createDataFrame([(1, None, 9), (2, "grumble vileness snarling", 9), (2, "ame", 9)], "doc_id long, text string, score int")
    assert sorted(str(tuple(r)) for r in toxicity.clean(rows, model).collect() if not r["text"] or "vile" not in r["text"]) == ["(1, None, 9)", "(2, 'ame', 9)"]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in toxicity.score(d, model).collect()} == {0}


def test_ratios_are_those_of_a_plain_count(spark):
    """Every expression of a tiny corpus, against the formulas written out over dictionaries."""
    from collections import Counter, defaultdict
    from math import isclose, log

    texts = [("you utter fool you fool", 1), ("the fool on the hill", 0), ("you and the hill and you", 0), ("fool fool fool", 1), ("the été étés the hill the hill", 0), ("", 1)]
    df = spark.createDataFrame(texts, "text string, toxic int").repartition(2)
    pairs = df.mapInArrow(toxicity._pairs, "h long, v long, w long, s long, t long, o long")
    from pyspark.sql import functions as F

    pairs = pairs.groupBy("h").agg(*(F.min(c).alias(c) for c in "vws"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    got = [sorted(r["ratio"] for r in d.collect()) for d in toxicity.log_ratios(pairs)]
    d_ = toxicity.DISCOUNT
    n = {c: Counter() for c in "to"}
    for t, y in texts:
        w = t.split()
        n["to"[1 - y]].update(zip([""] + w, w, strict=False))
    every = set(n["t"]) | set(n["o"])
    k = {c: Counter(w for _, w in n[c]) for c in "to"}
    words = {w for _, w in every}
    ks = {c: Counter() for c in "to"}
    for c in "to":
        for w, x in k[c].items():
            ks[c][w[: toxicity.STEM]] += x

    def level(counts, low):
        total = {c: sum(counts[c].values()) for c in "to"}
        mass = {c: sum(min(x, d_) for x in counts[c].values()) for c in "to"}
        return lambda x: {c: (max(counts[c][x] - d_, 0) + mass[c] * low(x, c)) / total[c] if total[c] else low(x, c) for c in "to"}

    share = lambda counts: lambda x: sum(counts[c][x] / max(1, sum(counts[c].values())) for c in "to") / 2
    stem = level(ks, lambda s, c: share(ks)(s))
    tilt = lambda p, c: p[c] / ((p["t"] + p["o"]) / 2)
    word = level(k, lambda w, c: share(k)(w) * tilt(stem(w[: toxicity.STEM]), c))
    heads = defaultdict(lambda: {c: Counter() for c in "to"})
    for c in "to":
        for (v, w), x in n[c].items():
            heads[v][c][w] += x

    def pair(v, w):
        h = heads[v]
        joint = (h["t"][w] + h["o"][w]) / (sum(h["t"].values()) + sum(h["o"].values()))
        return level(h, lambda w, c: joint * tilt(word(w), c))(w)

    ratio = lambda p: log(p["t"] / p["o"])
    want = [sorted(ratio(stem(s)) for s in {w[: toxicity.STEM] for w in words}), sorted(ratio(word(w)) for w in words), sorted(ratio(pair(*x)) for x in every)]
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b) and all(isclose(x, y, abs_tol=1e-5) for x, y in zip(a, b, strict=True))
