"""Tables, and the attributes that queries and their SQL give the driver's documents.

The driver's tables have no guideline metadata, so documents get it by rule: sites are their language, the content type
and the page follow from the id, even ids are current, and current recommendations are canonical. Benchmark items are the
questions, each with the vector of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ["recommendation", "evidence", "evidence_table", "rationale", "methodology"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt out anew where it is so small that its files keep less than the session's cores busy.

    A table of at least as many splits as cores is read as it is, so nothing large is ever shuffled for this.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_attributes(docs: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    out = docs.withColumn("sites", F.array("lang")).withColumn("content_type", kind).withColumn("is_current", F.col("doc_id") % 2 == 0)
    out = out.withColumn("canonical", F.col("is_current") & (F.col("content_type") == "recommendation"))
    return out.withColumn("page", F.col("doc_id") % 50).withColumn("recommendation_id", F.concat(F.lit("1."), F.col("doc_id") % 16 + 1, F.lit("."), F.col("page")))


#: The same in SQL.
ATTRIBUTES = """
attrs AS (
  SELECT doc_id, text, source, lang, [lang] AS sites, ['recommendation', 'evidence', 'evidence_table', 'rationale', 'methodology'][CAST(doc_id % 5 + 1 AS BIGINT)] AS content_type,
         doc_id % 2 = 0 AS is_current, doc_id % 2 = 0 AND doc_id % 5 = 0 AS canonical, doc_id % 50 AS page,
         '1.' || CAST(doc_id % 16 + 1 AS VARCHAR) || '.' || CAST(doc_id % 50 AS VARCHAR) AS recommendation_id
  FROM documents
)"""


def values(rows: list[tuple], *names: str) -> str:
    """A SQL VALUES relation of literals."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float, bool)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
