import corpus_pipeline


def test_stages_keep_the_columns_and_the_clean(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "sentencepiece"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs, data).columns == cols
    assert corpus_pipeline.mask_personal_data(spark, docs, data).columns == cols
    assert corpus_pipeline.mix_sources(spark, docs, data).columns == cols
    assert corpus_pipeline.mask_personal_data(spark, docs, data).count() == docs.count()


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids"] and out.count() > 0


def test_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


#: doc_id, text, lang, source, n_chars and columns whose names the stages might use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, _text string, key long, spans string, masks string, pass int, size long, times int, value string, ids string"
LONG = " ".join(f"word{i}" for i in range(3000))


def odd(spark):
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, None), (None, ""), (3, ""), (4, "write to a.b@example.org or +49 30 1234567 now"), (None, "a text of its own, with no id"), (5, LONG), (6, " \t\n")]
    more = (None, 7, "s", "m", 1, 9, 2, "v", "i")
    rows = [(i, t, "en", None if i == 4 else "src", 0 if t is None else len(t), *more) for i, t in texts]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_odd_rows_go_through_every_stage(spark, data):
    docs = odd(spark)
    clean = corpus_pipeline.drop_toxic(spark, docs, data)
    assert clean.columns == docs.columns and clean.count() == 10  # nothing here is toxic
    once = corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()
    assert sorted((r.text or "").strip()[:5] for r in once) == ["", "a tex", "one t", "word0", "write"]
    assert [r.doc_id for r in once if r.text and r.text.startswith("one")] == [1] and [r.doc_id for r in once if not (r.text or "").strip()] == [3]
    masked = corpus_pipeline.mask_personal_data(spark, docs, data)
    got = [r for r in masked.collect() if r.doc_id == 4]
    assert masked.count() == 10 and masked.columns == docs.columns and [r.text for r in got] == ["write to <EMAIL> or <PHONE> now"] and got[0].n_chars == len(got[0].text)
    assert masked.where("text is null and n_chars is not null").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, data)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    encoded = corpus_pipeline.encode_pieces(spark, docs, data).collect()
    assert len(encoded) == 10 and sum(r["n_ids"] == 0 for r in encoded) == 3


def test_components_of_a_path_and_a_star(spark):
    from millrace.llm.graph import components

    rows = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(300)}
