"""From raw documents to token ids: toxicity filter, near-dedup, masking of personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns the
documents that go on with the columns of documents; the last returns their token ids. docs may have further
columns of any names. Null texts count as empty; null and repeated ids, repeated rows and empty tables are
fine: what each stage makes of them its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, pieces, pii, simhash, toxicity
from millrace.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled ones that aren't held out.
    Rows are judged by their text alone, so equal texts go or stay together; null texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash: that with the least id, null last. Null and
    empty texts are one group."""
    return simhash.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars corrected. Null texts stay null."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents come whole, as often as the mix takes them. Those without words
    are not taken; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, in place of the text; null and empty texts have none."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Models, fingerprints and pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
