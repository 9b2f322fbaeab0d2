"""Sharding and mixing."""

from collections import Counter

import pytest
from parity import both, views

from millrace.llm import mixing, sharding


def brute_table(shards, slots):
    """Preference lists written out, then turns."""
    import hashlib

    lists = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        lists.append([(a + i * b) % slots for i in range(slots)])
    out = [None] * slots
    while None in out:
        for i, order in enumerate(lists):
            free = next((x for x in order if out[x] is None), None)
            if free is None:
                break
            out[free] = i
    return out


def test_table_is_that_of_turns():
    for n in (1, 2, 5, 7):
        shards = [f"s{i}" for i in range(n)]
        assert sharding.lookup_table(shards, 101) == brute_table(shards, 101)
    got = Counter(sharding.lookup_table(sharding.SHARDS))
    assert max(got.values()) - min(got.values()) <= 1 and len(got) == len(sharding.SHARDS)


def test_removing_a_shard_moves_few_others():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    others = [(x, y) for x, y in zip(a, b, strict=True) if x != 19]
    assert sum(x != y for x, y in others) < 0.1 * len(others)


@pytest.mark.parametrize("bad", [((), 101), (("a", "a"), 101), (("a",), 100), (tuple("abcd"), 3)])
def test_bad_tables(bad):
    with pytest.raises(ValueError, match="shards"):
        sharding.lookup_table(*bad)


def test_placing(spark):
    df = spark.createDataFrame([(1, "a", "z"), (1, "b", "z"), (None, "c", "z"), (2, None, None)], "doc_id long, shard string, k string")
    out = sharding.place(df, "doc_id").collect()
    assert len(out) == 4 and out[0].__fields__ == ["doc_id", "k", "slot", "shard"] and all(r["shard"] in sharding.SHARDS for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, "doc_id", str(tmp_path / "s"), ["a", "b", "c"])
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 500 and got.select("shard").distinct().count() == 3


def test_mix_equals_its_closed_form(spark, data):
    mine, theirs = both(spark, views(data), mixing.op8_mixing, mixing.ORACLE_SQL, data)
    assert mine == theirs


def docs(spark, rows):
    return spark.createDataFrame(rows, "key long, source string, size long")


def test_mix_meets_targets_and_bounds(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", (i * 37) % 90) for i in range(900)] + [(5, None, 40), (5, None, 40), (6, None, 0), (6, None, 0), (7, "empty", 0)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 2 * len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 and t <= 2 * size[s] + 1e-9
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_small_sources_keep_their_targets_under_large_blocks(spark):
    # blocks of some 1,900 words: targets of 6, 1,600 and 3,200 words aren't whole blocks
    rows = [(i, "big", 500) for i in range(40)] + [(100, "few", 3), (101, None, 4), (102, None, 700)] + [(110 + i, "mid", 100) for i in range(8)]
    got = mixing.mix(docs(spark, rows), slots=16).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
    assert all(abs(taken[s] - t) <= 1 and taken[s] > 0 for s, t in target.items()), (taken, target)
    # more sources than slots
    many = mixing.mix(docs(spark, [(i, f"s{i}", 10) for i in range(50)]), slots=16).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert len(many) == 50 and all(abs(r["sum(taken)"] - r["target"]) <= 1 for r in many)


def test_waterfilling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 100)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # a and c stop at 20, the null source (weight 3) at 200, b takes what is left
    assert t == pytest.approx({"a": 20, "c": 20, None: 200, "b": 1680 - 240})


def test_schedule_is_even(spark):
    goals = mixing.quotas(spark.createDataFrame([("a", 4000), ("b", 4000), ("c", 4000)], "source string, source_size long"))
    order = [r["source"] for r in mixing.schedule(goals).orderBy("slot").collect()]
    all_, part = Counter(order), Counter(order[: len(order) // 3])
    for s in all_:
        assert abs(part[s] - all_[s] / 3) < 12
    ranks = mixing.schedule(goals).groupBy("source").agg({"rank": "max", "slot": "count"}).collect()
    assert all(r["max(rank)"] + 1 == r["count(slot)"] for r in ranks)


def test_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixed_documents(spark):
    rows = [(i, f"word{i} " * (i % 5), "s1" if i % 2 else None, "x", 0) for i in range(60)] + [(60, None, "s1", "x", 0), (3, "word3 " * 3, "s1", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string, n_chars long")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    words = sum(len((r[1] or "").split()) for r in rows)
    # the documents at which targets end come whole: one of 12 words a source at most
    assert -2 <= sum(len(r["text"].split()) for r in got) - 1.5 * words <= 24 and {tuple(r) for r in got} <= set(rows)


def test_every_prefix_of_the_mix_is_near_its_weights(spark):
    """Documents of one word each, so that blocks are documents: up to any slot, each source has its share of the words
    to within a few blocks."""
    rows = [(i, "w", f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r["source"] for r in mixing.mixed_documents(df, slot="place").orderBy("place").collect()]
    total = Counter(order)
    assert sum(total.values()) == 4500
    seen = Counter()
    for i, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - i * total[x] / len(order)) < 14 for x in total)
    back = [r["source"] for r in mixing.mixed_documents(df).collect()]
    assert Counter(back) == total


def test_documents_that_differ_in_one_column_stay_apart(spark):
    rows = [(1, "a b c", "s", lang, "k", "t") for lang in ("x", "y", None, "x")] + [(9, "w " * 30, "big", "x", "k", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key string, times string")
    got = Counter(tuple(r) for r in mixing.mixed_documents(df, share=2.0).collect())
    assert got == {r: 2 * n for r, n in Counter(rows).items()}


def test_sources_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"s{i % 9}", 1 + i % 13) for i in range(300)]
    want = sorted(map(str, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(mixing, "RANGE", 1)
    assert sorted(map(str, mixing.mix(docs(spark, rows)).collect())) == want


def test_slots_of_rows_and_clashing_names(spark):
    import struct

    import xxhash

    df = spark.createDataFrame([(i, "a", "b") for i in (1, 2, -7, 1 << 40)], "doc_id long, at string, owner string")
    names = sharding.lookup_table(sharding.SHARDS)
    for r in sharding.place(df, "doc_id").collect():
        h = struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest(str(r["doc_id"]), 42)))[0]
        assert r["slot"] == h % sharding.SLOTS and r["shard"] == sharding.SHARDS[names[r["slot"]]] and (r["at"], r["owner"]) == ("a", "b")
    long = spark.createDataFrame([("x" * 200000,), ("",), (None,)], "k string")
    got = {r["n"]: r["slot"] for r in sharding.place(long, "k").selectExpr("length(k) AS n", "slot").collect()}
    assert got[0] == got[None] and got[200000] == struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest("x" * 200000, 42)))[0] % sharding.SLOTS
