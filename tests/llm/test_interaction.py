"""The filter audit against a plain simulation of every order."""

import re
from fractions import Fraction
from itertools import permutations

import pytest
from parity import both, views

from millrace.llm import interaction
from millrace.llm.interaction import Removal, audit, report


def simulated(docs, labels):
    """docs: (doc_id, lang, text)."""
    texts = [(i, lang or "", t or "") for i, lang, t in docs]
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    rows = []
    for i, part, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, _, u in texts) else set()
        rows.append((part, i, fails))
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(i, f) for p, i, f in rows if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shares[x] += len(gone)
                failing = sum(x in f for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (1, "en", LONG), (2, "en", LONG), (2, "en", LONG), (3, "de", LONG), (None, "en", LONG), (None, None, "few # words"), (4, None, None), (5, "", ""), (6, "de", "  "),
    (7, "fr", "word " * 300), (8, "fr", "SHOUT " * 300), (9, "en", LONG + " 5%"), (10, "en", "A\tb\nc\x0bd\x0ce\rf"), (11, "en", "\U0001f600" * 40 + "A"), (12, "de", " ".join(f"x{i}" for i in range(20_000))),
    (-3, "fr", LONG + " 5%"), (13, "en", "few # words"), (14, "en", LONG.lower() + "\n"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, None), (9, 1, 1), (99, 1, 1), (8, 0, 1)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, "x", 1, "y") for i, p, t in docs], "doc_id long, text string, lang string, key string, n long, part string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_simulation(spark):
    got = audit(*frames(spark, DOCS, LABELS)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == simulated(DOCS, LABELS)


def test_hot_copies(spark):
    docs = [(i, "en" if i % 3 else "fr", "the same line" if i % 2 else f"line {i}") for i in range(3000)]
    got = audit(*frames(spark, docs, []))
    row = got.where("part = 'en' and filter_order = 'EABCD' and step = 1").first()
    assert row.removed == sum(1 for i, p, t in docs if p == "en" and t == "the same line" and i > 1)


def test_empty(spark):
    assert audit(*frames(spark, [], LABELS)).count() == 0


def test_polynomial():
    removal = Removal([5, 3, 0, 2])  # masks none, A, B, AB
    assert [removal.at(s) for s in range(4)] == [0, 5, 2, 5]
    assert removal.shapley(0) == Fraction(4) and removal.shapley(1) == Fraction(1)
    with_all = Removal([0] * 31 + [7])
    assert [with_all.shapley(i) * 120 for i in range(5)] == [7 * 24] * 5
    assert sum(r[4] for r in report("", "ABCDE", [1] * 32, [0] * 32, [0] * 32) if r[1] == "ABCDE") == 31


@pytest.mark.parametrize("name", sorted(interaction.ORACLE))
def test_same_rows_as_sql(spark, data, name):
    mine, theirs = both(spark, views(data), interaction.QUERIES[name], interaction.ORACLE[name], data)
    assert mine == theirs
