import random

import pyarrow as pa
import pytest

from millrace.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def test_ids_are_those_of_the_library(model, vocabulary):
    rng = random.Random(1)
    letters = "ab the▁ \n\t.é日本語😀ing 12aaaa%%%&&&x\x00​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", "   ", "a" * 500, "日本" * 300, "the" * 4000, " " * 50, "▁▁a", "<s> </s> <unk> <0x41>"]
    ids, n = vocabulary.encode(pa.array([*texts, None]))
    at = 0
    for t, k in zip([*texts, ""], n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == model.encode(t), t
        at += k
    back = vocabulary.decode(ids, n).to_pylist()
    assert back[:-1] == [model.decode(model.encode(t)) for t in texts]
    assert all(b == t for b, t in zip(back, texts, strict=False) if "▁" not in t)


def test_decoding_odd_ids(vocabulary, model):
    import numpy as np

    lone = [vocabulary.byte_ids[0xE6], vocabulary.byte_ids[0x97]]
    assert vocabulary.decode(np.array([*lone, 1, 2], np.int32), np.array([1, 1, 2])).to_pylist() == ["�", "�", ""]
    with pytest.raises(ValueError, match="vocabulary"):
        vocabulary.decode(np.array([99999], np.int32), np.array([1]))


def test_edges_are_all_occurrences(vocabulary):
    import numpy as np

    text = "▁the▁theirs"
    codes = np.append(vocabulary.code[[ord(c) for c in text]], np.uint64(0))
    found = {(int(i), int(k) + 2): int(v) - 1 for (i, k), v in np.ndenumerate(vocabulary.edges(codes)) if v}
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {(i, j - i): m.piece_to_id(text[i:j]) for i in range(len(text)) for j in range(i + 2, len(text) + 1) if m.piece_to_id(text[i:j]) != m.unk_id()}
    assert found == want


def test_rows(spark):
    rows = [(1, "Hello world", "x", 2), (1, "Hello world", "x", 2), (None, None, None, None), (3, "", "", 0), (4, "long " * 30000, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int")
    out = pieces.encode(df, check=True)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"] and all(r["round_trip"] and len(r["ids"]) == r["n_ids"] for r in out.collect())
    back = pieces.decode(out.select("doc_id", "ids"))
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((i, t or "")) for i, t, *_ in rows)
    assert pieces.encode(df.limit(0)).count() == 0


def test_the_query_matches_the_library(spark, data, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in pieces.op4_sentencepiece(spark, data).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]]) and r["round_trip"]
