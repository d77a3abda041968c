"""Ranking, refusal and citation metrics over tables of results and gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import in_blocks


def relevant(gold_ids="gold_ids", gold_types="gold_types", gold_sites="gold_sites", result="recommendation_id", gold_records=None, record="doc_id"):
    """A result is relevant by its id, or by its type and a shared site where gold names both; by its record too, if asked."""
    by_id = F.coalesce(F.array_contains(gold_ids, F.col(result)), F.lit(False))
    if gold_records is not None:
        by_id = by_id | F.coalesce(F.array_contains(gold_records, F.col(record)), F.lit(False))
    return by_id | (F.coalesce(F.array_contains(gold_types, F.col("content_type")), F.lit(False)) & F.coalesce(F.arrays_overlap("sites", gold_sites), F.lit(False)))


def gold_in_corpus(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, gold: how many chunks are relevant to each question (gold: query_id and the columns that relevant names).

    Chunks are counted by the attributes that relevance looks at; only those few rows meet the questions, and the chunks that
    a question names as records.
    """
    kinds = chunks.groupBy("recommendation_id", "content_type", "sites").agg(F.count("*").alias("n"))
    by_kind = in_blocks(gold, "query_id", lambda own: kinds.crossJoin(F.broadcast(own)).where(relevant()).groupBy("query_id").agg(F.sum("n").alias("n")))
    named = gold.select("*", F.explode(F.array_distinct("gold_records")).alias("doc_id")).join(chunks, "doc_id").where(~relevant())
    by_record = named.groupBy("query_id").agg(F.count("*").alias("n"))
    both = by_kind.unionByName(by_record).groupBy("query_id").agg(F.sum("n").alias("gold"))
    return gold.select("query_id").join(both, "query_id", "left").select("query_id", F.coalesce("gold", F.lit(0)).alias("gold"))


def per_query(results: DataFrame, queries: DataFrame, cuts=(3, 5)) -> DataFrame:
    """query_id, first_rank (null: a miss), p_at_k: hits in the first k over k, also of shorter lists. results: query_id, rank, relevant."""
    hits = [F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits_{k}") for k in cuts]
    per = results.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), *hits)
    out = queries.select("query_id").join(per, "query_id", "left")
    return out.select("query_id", "first_rank", *[(F.coalesce(f"hits_{k}", F.lit(0)) / k).alias(f"p_at_{k}") for k in cuts])


def recall_at(k: int):
    return F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0))


def mrr():
    return F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def non_gold_reason(seen="seen"):
    """Why a result isn't gold: the first of these that holds."""
    ids, sites, types = F.col("gold_ids"), F.col("gold_sites"), F.col("gold_types")
    shared = F.arrays_overlap("sites", "gold_sites")
    return (
        F.when(F.col(seen), "duplicate_unit")
        .when(F.arrays_overlap("gold_ids", "related_ids"), "close_context_referencing_gold_id")
        .when((F.size(sites) > 0) & (F.size("sites") > 0) & ~shared, "wrong_cancer_site")
        .when((F.size(types) > 0) & ~F.array_contains(types, F.col("content_type")), "wrong_content_type")
        .when((F.size(ids) > 0) & shared & F.col("content_type").isin("recommendation", "symptom_table"), "same_site_alternative_unit")
        .when(shared, "same_site_context")
        .when(F.size("sites") == 0, "general_context")
        .otherwise("other")
    )


def floor_rank(values, p: float):
    """The value at rank max(1, floor(p n)) of a sorted collected list; for bounded windows of recent rows."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.greatest(F.lit(1), F.floor(F.size(ordered) * p)).cast("int"))


def best_configuration(metrics: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the largest metrics, compared in turn; the first in `order` of equals."""
    w = Window.orderBy(*[F.desc(c) for c in by], order)  # a row per configuration
    return metrics.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
