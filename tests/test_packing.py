"""Packing against a search over all lengths."""

import json
import random

from millrace.operators import packing as P


def slow(candidates, targets, budget):
    out, used, chosen, covered, docs = [], [], set(), set(), []
    cap = 6 if len({c["document"] for c in candidates}) == 1 else 3

    def attempt(i):
        c = candidates[i]
        if i in chosen or docs.count(c["document"]) >= cap:
            return False
        whole = P.crop(c["content"], c["child"], 1200)
        best = None
        for n in range(len(whole) + 1):
            text = P.crop(whole, c["child"], n)
            line = P.envelope(c["document"], c["evidence"], text, c["headings"])
            if len("\n".join([*used, line])) <= budget:
                best = (text, line)
        if best is None or not best[0].strip("… \n\r\t"):
            return False
        out.append((i, *best))
        used.append(best[1])
        chosen.add(i)
        docs.append(c["document"])
        covered.update(c["targets"])
        return True

    for t in targets:
        if t in covered:
            continue
        for i, c in enumerate(candidates):
            if t in c["targets"] and attempt(i):
                break
    for i in range(len(candidates)):
        attempt(i)
    return out


def made(rng, n):
    letters = 'ab "\\\nä中'
    return [{"document": str(rng.randrange(3)), "evidence": f"e{i}", "content": "".join(rng.choices(letters, k=rng.randrange(0, 400))), "child": rng.choice(["", "ab", "zz"]), "headings": rng.choice([[], ["h", "é"]]), "targets": rng.sample(["x", "y", "z"], rng.randrange(3))} for i in range(n)]


def test_equals_the_search_over_all_lengths():
    rng = random.Random(3)
    for _ in range(40):
        c, budget = made(rng, rng.randrange(1, 9)), rng.choice([0, 90, 130, 300, 700, 1500])
        got = P.pack(c, ["z", "x", "q"], budget)
        assert got == slow(c, ["z", "x", "q"], budget)
        assert len("\n".join(x[2] for x in got)) <= budget


def test_crops_are_nested_and_within_their_limit():
    text = "".join(chr(97 + i % 26) for i in range(300))
    for child in ("", text[5:9], text[150:160], text[295:], "missing"):
        last = 0
        for n in range(301):
            got = P.crop(text, child, n)
            assert len(got) <= max(n, 2 if n else 0) and len(got) >= last
            last = len(got)
    assert P.crop("abc", "b", 3) == "abc" and P.crop("abc", "b", 0) == ""


def test_a_document_alone_gives_more():
    c = [{"document": "1", "evidence": f"e{i}", "content": f"text {i}", "child": "", "headings": [], "targets": []} for i in range(9)]
    assert len(P.pack(c, [], 12_000)) == 6
    c[8]["document"] = "2"
    assert [x[0] for x in P.pack(c, [], 12_000)] == [0, 1, 2, 8]
    assert json.loads(P.pack(c, [], 12_000)[0][2])["trust"] == "untrusted_data"


def test_packed_by_request(spark):
    rows = [(q, r, "d", f"e{r}", None if r == 2 else f"text {r}", "", None, ["x"]) for q in (1, None) for r in range(4)]
    df = spark.createDataFrame(rows, "q long, rank int, document string, evidence string, content string, child string, headings array<string>, targets array<string>")
    got = P.packed(df, "q", ["x"]).collect()
    assert sorted((r.q or 0, r.position, r.evidence) for r in got) == [(q, p, e) for q in (0, 1) for p, e in ((1, "e0"), (2, "e1"), (3, "e3"))]
    assert P.packed(df.limit(0), "q", []).count() == 0
