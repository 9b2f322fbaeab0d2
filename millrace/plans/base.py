"""The given tables in the roles that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as search units: ten to a parent, source as tenant, language as content type, good
    quality as active."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("child_id"), F.floor(F.col("doc_id") / 10).alias("parent_id"), F.col("source").alias("user_id"), F.col("lang").alias("content_type"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_active"), "text", "n_chars",
    )


#: The same in SQL.
CHUNKS = """chunks AS (SELECT d.doc_id AS child_id, d.doc_id // 10 AS parent_id, d.source AS user_id, d.lang AS content_type,
  coalesce(l.quality, 0) = 1 AS is_active, d.text, d.n_chars FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of a customer's document, numbered in order of date."""
    o = table(spark, d, "orders")
    from pyspark.sql import Window as W

    no = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "building").otherwise("inactive")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), no.alias("version_no"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("priority"))


VERSIONS = """versions AS (SELECT o_orderkey AS version_id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'building' ELSE 'inactive' END AS status, o_orderdate AS created_at, o_totalprice AS size, o_orderpriority AS priority FROM orders)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as versioned documents: the active version is the last active one; a negative balance
    marks a deleted document."""
    v = versions(spark, d).where("status = 'active'").groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("active_version_id"))
    c = table(spark, d, "customer")
    status = F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active")
    docs = c.select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("user_id"), F.col("c_nationkey").alias("nation_id"), status.alias("status"))
    return docs.join(v, "document_id", "left")


DOCUMENTS = """docs AS (SELECT c.c_custkey AS document_id, c.c_mktsegment AS user_id, c.c_nationkey AS nation_id, CASE WHEN c.c_acctbal < 0 THEN 'deleted' ELSE 'active' END AS status, v.active_version_id
  FROM customer c LEFT JOIN (SELECT document_id, max_by(version_id, version_no) AS active_version_id FROM versions WHERE status = 'active' GROUP BY document_id) v ON c.c_custkey = v.document_id)"""
