import hashlib
import re

from millrace.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "no data here", "mail a.b+c@d-e.co.uk. or x@y@z.com%q@r.de", "😀é 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.004",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111 and 1 2", "+1 (523) 555-1055 +12 +49.30.1234567 (0) +1234567890123456", "a@b" + ".c" * 20000, "9" * 30000, "9 " * 10000,
    "x" * 50000, "call me at (415) 555-2671 today", "write to jane [at] mail [dot] example [dot] com please", "+1 (523) 555-1055 4111 1111 1111 1111", "+" * 500 + "1.1.1.1@x.y", "٣٤٥ １２３", "v 1.2.3.4-5@a.b",
]


def luhn(x):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def spans(t):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


def frame(spark):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int, n_email string")


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = pii.candidates(frame(spark).select("doc_id", "text"))
    for r in pii.found(rows, (0.0,) * 10).collect():
        want = spans(TEXTS[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (TEXTS[r["doc_id"]] or "")[:60]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_the_classifier_adds_likely_spans(spark):
    rows = pii.candidates(frame(spark).select("doc_id", "text"))
    got = {r["doc_id"]: r["spans"] for r in pii.found(rows, pii.fit(rows)).collect()}
    assert got[11] == "phone:11:25" and got[12].startswith("email:9:") and got[2] == ""


def test_unlikely_spans_stay_out(spark):
    text = "order 415-555-2671/77, part no 1234.5678.1234.5678"
    rows = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert pii.found(rows, pii.fit(rows)).first()["spans"] == ""


def test_expectation_maximisation_tells_reliable_labelers():
    got = pii.reliabilities([(0, 15, 500), (0, 7, 80), (0, 0, 400), (0, 4, 90), (0, 30, 20), (0, 20, 20)])
    assert got[0, 15] > 0.95 and got[0, 0] < 0.05 and got[0, 30] > 0.8 > got[0, 4] and got[0, 20] < 0.5
    assert pii.reliabilities([]) == {} and pii.classifier([]) == (0.0,) * 10


def test_masking(spark):
    df = spark.createDataFrame([(1, "é a@b.co and 10.0.0.1!", "en", 22), (2, None, "en", None), (3, "clean", "en", 5), (3, "clean", "en", 5)], "doc_id long, text string, lang string, n_chars long")
    out = pii.masked(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    assert got == [(1, "é <EMAIL> and <IP>!", 19), (3, "clean", 5), (3, "clean", 5)]


def test_overlapping_spans_are_masked_once(spark):
    out = pii.masked(spark.createDataFrame([(1, "1.1.1.1@x.y z")], "doc_id long, text string")).first()
    assert out["text"] == "<EMAIL> z"


def test_no_rows(spark):
    rows = pii.candidates(frame(spark).select("doc_id", "text").limit(0))
    assert pii.found(rows, pii.fit(rows)).count() == 0


def test_the_trained_weights_alone_decide(spark):
    """Labelers taken for the reverse of what they are add other spans."""
    rows = pii.candidates(frame(spark).select("doc_id", "text"))
    weights = pii.fit(rows)
    mine, turned = ({r["doc_id"]: r["spans"] for r in pii.found(rows, w).collect()} for w in (weights, tuple(-x for x in weights)))
    assert mine[11] == "phone:11:25" and turned[11] == ""
    never = pii.found(rows, (-99.0,) * 4 + (0.0,) * 6).collect()
    assert all(r["spans"].count(":") == 2 * sum(r[f"n_{k}"] for k in BASE) for r in never)


def test_many_matches_in_one_text(spark):
    text = "a@b.co é " * 6000
    df = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id long, text string, spans string, _h0email string, masks string")
    got = pii.found(pii.candidates(df.select("doc_id", "text")), (0.0,) * 10).first()
    assert got["n_email"] == 6000 and got["spans"].endswith(f"email:{9 * 5999}:{9 * 5999 + 6}")
    out = pii.masked(df).first()
    assert out["text"] == "<EMAIL> é " * 6000 and (out["spans"], out["_h0email"], out["masks"]) == ("x", "y", "z")
