"""The engine's relations, projected from the tables at hand.

``manifest``: one row per document with its attributes.  ``blocks``: a document's
lines with a structural position.  ``records``: coded answers of (unit, question).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADING_CHARS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(
        "doc_id",
        F.col("lang").alias("genre"),
        F.col("source").alias("family"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 942).cast("int")).alias("date"),
        F.col("n_chars").alias("total_chars"),
    )


#: DuckDB text of the same relation.
MANIFEST_SQL = "(SELECT doc_id, lang AS genre, source AS family, DATE '2024-01-01' + CAST(doc_id % 942 AS INTEGER) AS date, n_chars AS total_chars FROM documents)"


def blocks(docs: DataFrame) -> DataFrame:
    """Lines of ``doc_id, text`` with their ordinal and structural position."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    position = F.when(F.col("ord") == 0, "title").when(F.length("text") <= HEADING_CHARS, "section_heading").when(F.col("text").contains('"'), "quotation").otherwise("body")
    return lines.withColumn("position", position)


BLOCKS_SQL = f"""(SELECT doc_id, ord, text, CASE WHEN ord = 0 THEN 'title' WHEN length(text) <= {HEADING_CHARS} THEN 'section_heading'
  WHEN contains(text, '"') THEN 'quotation' ELSE 'body' END AS position
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ord FROM documents))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("unit"),
        F.col("event_type").alias("question"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        F.col("value").alias("confidence"),
        F.col("props").alias("payload"),
        F.col("event_id").alias("ordinal"),
        F.col("ts").alias("made_at"),
    )


RECORDS_SQL = "(SELECT user_id AS unit, event_type AS question, CASE WHEN event_type = 'error' THEN 'failed' END AS error, value AS confidence, props AS payload, event_id AS ordinal, ts AS made_at FROM events)"
