"""Index and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..functions import vocabulary as V
from ..operators import engine, index, lexical, ranking, search
from ..store import stash
from .common import ATTRIBUTES, literal, table, texts, values, with_attributes

P = V.TOKEN
#: Token and BM25 relations shared by the SQL below.
TOKENS = f"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{P}') AS tk FROM documents), dls AS (SELECT doc_id, len(tk) AS dl FROM toks)"
BM25 = f"""{TOKENS},
corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM dls),
qt AS (SELECT query_id, term, least(count(*), 2) AS qw FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{P}')) AS term FROM benchmark)
       WHERE term NOT IN ('about', 'the', 'what') GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
idfs AS (SELECT term, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) * qw) AS bm25
       FROM qt JOIN tf USING (term) JOIN idfs USING (term) JOIN dls USING (doc_id), corpus GROUP BY ALL)"""


def tokenize_counts(spark, sf):
    return index.postings(texts(spark, sf)).groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("terms"), F.max("tf").alias("top_tf"))


def lexicon(spark, sf) -> lexical.Index:
    """The stored index of documents, built by the first query that asks for it."""
    return lexical.opened(spark, f"{sf}/documents.parquet", lambda: texts(spark, sf))


def term_stats(spark, sf):
    return lexicon(spark, sf).stats().withColumn("idf", F.round("idf", 8))


def doc_lengths(spark, sf):
    docs = lexicon(spark, sf).documents
    return docs.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("mean"), F.count_if(F.col("dl") == 0).alias("empty"))


def _ranked(scored, k=10):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(spark, sf):
    hits = lexical.topk(lexicon(spark, sf), table(spark, sf, "benchmark"), 10)
    return _ranked(hits.select("query_id", "doc_id", F.round("bm25", 6).alias("score")))


def bm25_filtered(spark, sf):
    docs, questions = texts(spark, sf), table(spark, sf, "benchmark")
    may = search.allowed(with_attributes(docs), ["fr", "en"], ["recommendation", "rationale"]).select("doc_id")
    return _ranked(lexical.topk(lexicon(spark, sf), questions, 5, among=may).select("query_id", "doc_id", F.round("bm25", 6).alias("score")), 5)


def dense_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return search.dense_topk(rows, rows.where("vec_id % 100 = 0"))


def dense_rescaled(spark, sf):
    rows = table(spark, sf, "embeddings")
    each = search.dense_range(rows, rows.where("vec_id % 100 = 0"))
    return each.select("query_id", *(F.round(vectors.rescaled(c), 6).alias(c) for c in ("best", "worst")), "rows")


def vector_units(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(vectors.norm(vectors.unit("embedding")), 6).alias("unit_norm"))


def manifest_check(spark, sf):
    return index.manifest(table(spark, sf, "embeddings"))


def _sides(spark, sf):
    """Chunks and questions with their vectors, where there are any."""
    docs, emb = texts(spark, sf), table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = table(spark, sf, "benchmark")
    questions = asked.join(emb, F.col("item_id") == F.col("vec_id"), "left")
    questions = stash(questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("embedding").alias("vector")), "questions")
    chunks = with_attributes(docs.drop("text")).join(emb, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")
    return stash(chunks, "chunks"), questions


def _first(spark, sf, **more):
    """The first stage over all documents."""
    return ranking.best(lexicon(spark, sf), *_sides(spark, sf), whole=True, **more)


def hybrid_topk(spark, sf):
    chunks, questions = _sides(spark, sf)

    def run(block):
        read = stash(search.read_questions(block), "questions-read")
        rows = ranking.candidates(lexicon(spark, sf), chunks, read, "hybrid", 10, False, True, boosted=False, digits=6, order=ranking.BY_ID)
        rows = rows.select("query_id", "doc_id", "bm25", F.round("base", 6).alias("score"), F.round("bm25_norm", 6).alias("bm25_norm"), F.round("dense", 6).alias("dense"))
        return search.best_pairs(rows, 10, F.desc("score"), F.col("doc_id")).drop("bm25")

    return ranking.blocks(questions, run)


def hybrid_boosted(spark, sf):
    top = _first(spark, sf, coherent=False)
    return top.select("query_id", "doc_id", "first_rank", F.round("score", 6).alias("score"), F.round("adjustment", 6).alias("adjustment"))


def anchor_coherence(spark, sf):
    top = _first(spark, sf)
    return top.select("query_id", "doc_id", "first_rank", F.round("score", 6).alias("score"), F.array_join("anchor_sites", ",").alias("anchor_sites"))


def _reranked(spark, sf, k=10):
    top = _first(spark, sf)
    terms = search.salient_terms(table(spark, sf, "benchmark"), "item_id", "text")
    return search.rerank(top, lexical.coverage(lexicon(spark, sf), top, terms), k)


def rerank_topk(spark, sf):
    out = _reranked(spark, sf)
    return out.select("query_id", "doc_id", "rank", "first_rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("coverage", 6).alias("coverage"))


def search_results(spark, sf):
    """The public result rows: score detail as a struct's fields, explanations and citation."""
    out = _reranked(spark, sf, 3)
    why = F.array_compact(
        F.array(
            F.when(F.col("asked_evidence") & F.col("content_type").isin(V.EVIDENCE_TYPES), "evidence-intent match"),
            F.when(~F.col("asked_evidence") & F.col("canonical"), "canonical current recommendation"),
            F.when(~F.col("asked_evidence") & ~F.col("canonical") & F.col("is_current"), "current authoritative source"),
            F.when(F.arrays_overlap("sites", "anchor_sites"), "site coherence from top canonical match"),
        )
    )
    cite = T.citation("Guideline", F.col("source"), F.col("recommendation_id"), F.col("page"), F.col("page"), F.when(F.col("is_current"), "current").otherwise("earlier"))
    return out.select("query_id", "rank", F.concat(F.lit("E"), F.col("rank")).alias("label"), "doc_id", F.round("dense", 6).alias("dense"), F.round("bm25_norm", 6).alias("bm25_norm"), F.array_join(why, "; ").alias("explanations"), cite.alias("citation"))


#: Questions that guards stop, with the guard.
STOPPED = [("s1", "Should a patient with prostate cancer symptoms be referred?", "scope_refusal"), ("a1", "Should this patient be referred?", "insufficient_information")]


def engine_search(spark, sf):
    """The public search from question to results: guards, fallback for want of vectors, boosts and coherence, without the reranker."""
    chunks = with_attributes(texts(spark, sf)).select("doc_id", "text", "sites", "content_type", "is_current", "canonical", "page", "recommendation_id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    asked = asked.unionByName(literal(spark, [x[:2] for x in STOPPED], "qid string, text string"))
    out = engine.search(asked, chunks, top_k=5, rerank=False, lexicon=lexicon(spark, sf))
    return out.select("qid", "outcome", "mode_used", "warning", "rank", "doc_id", "score")


#: What the filtered search may return.
FILTERS = {"sites": ["fr", "en"], "types": ["recommendation", "evidence", "rationale"]}


def engine_reranked(spark, sf):
    """The public search in full: hybrid by vectors and terms, filtered by sites and types, with the reranker."""
    chunks, questions = _sides(spark, sf)
    asked = questions.select(F.col("query_id").cast("string").alias("qid"), F.col("question").alias("text"), "vector")
    out = engine.search(asked, chunks, mode="hybrid", top_k=5, **FILTERS, lexicon=lexicon(spark, sf))
    return out.select("qid", "outcome", "mode_used", "rank", "first_rank", "doc_id", "score", "base", "coverage")


CAND = f"""{BM25}, {ATTRIBUTES},
qs AS (SELECT item_id AS query_id, b.text AS question, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark b LEFT JOIN embeddings e ON item_id = vec_id),
cand AS (
  SELECT query_id, question, a.*, coalesce(bm25, 0) AS bm, list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS cosine
  FROM attrs a LEFT JOIN embeddings e ON a.doc_id = e.vec_id CROSS JOIN qs LEFT JOIN bm USING (query_id, doc_id)
), fused AS (
  SELECT *, CASE WHEN max(bm) OVER w > 0 THEN bm / max(bm) OVER w ELSE 0 END AS bm25_norm, CASE WHEN cosine IS NULL THEN 0 ELSE greatest(0, least(1, (cosine + 1) / 2)) END AS dense
  FROM cand WINDOW w AS (PARTITION BY query_id)
), based AS (SELECT *, 0.55::DOUBLE * bm25_norm + 0.45::DOUBLE * dense AS base FROM fused)"""
BOOSTED = f"""{CAND}, flags AS (
  SELECT *, regexp_matches(question, '{V.EVIDENCE_TERMS}') AS asked_evidence, CAST([] AS VARCHAR[]) AS asked_sites FROM based
), boosted AS (
  SELECT *, adjustment AS adj0, greatest(0, base + adjustment) AS score FROM (
    SELECT *, CASE WHEN asked_evidence THEN CASE WHEN content_type IN ('evidence', 'evidence_table', 'rationale') THEN 0.06::DOUBLE ELSE 0 END
                   WHEN canonical THEN 0.22::DOUBLE WHEN is_current THEN 0.03::DOUBLE ELSE 0 END
              + CASE WHEN content_type = 'methodology' AND NOT regexp_matches(question, '{V.METHODOLOGY_TERMS}') THEN -0.04::DOUBLE ELSE 0 END
              + CASE WHEN list_contains(regexp_extract_all(question, '{V.RECOMMENDATION_ID}'), recommendation_id) THEN 0.30::DOUBLE ELSE 0 END AS adjustment FROM flags)
)"""
FIRST = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, is_current DESC, page, doc_id)"
ANCHORED = f"""{BOOSTED}, anchors AS (
  SELECT query_id, sites AS anchor_sites, score AS anchor_score FROM boosted WHERE canonical
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) = 1
), pulled AS (
  SELECT b.* EXCLUDE (score), CASE WHEN NOT asked_evidence AND round(anchor_score, 10) >= 0.75 THEN anchor_sites END AS anchor_sites, b.score AS score0
  FROM boosted b LEFT JOIN anchors USING (query_id)
), coherent AS (
  SELECT *, greatest(0, score0 + CASE WHEN anchor_sites IS NULL THEN 0 WHEN list_has_any(sites, anchor_sites) THEN 0.10::DOUBLE ELSE -0.06::DOUBLE END) AS score FROM pulled
), firsts AS (SELECT *, {FIRST} AS first_rank FROM coherent QUALIFY first_rank <= 20)"""
_stop = ", ".join(f"'{w}'" for w in V.RERANK_STOPWORDS)
RERANKED = f"""{ANCHORED}, st AS (
  SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{P}')) AS term FROM benchmark)
  WHERE term NOT IN ({_stop}) AND NOT regexp_full_match(term, '[0-9]+')
), post AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(tk) AS term FROM toks) WHERE term IN (SELECT term FROM st)),
sidf AS (SELECT term, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
whole AS (SELECT query_id, sum(idf) AS whole FROM st JOIN sidf USING (term) GROUP BY query_id),
held AS (SELECT query_id, doc_id, sum(idf) AS held FROM firsts JOIN st USING (query_id) JOIN post USING (doc_id, term) JOIN sidf USING (term) GROUP BY ALL),
cov AS (SELECT f.*, coalesce(held / whole, 0) AS coverage FROM firsts f LEFT JOIN held USING (query_id, doc_id) LEFT JOIN whole USING (query_id)),
types AS (SELECT query_id, CASE WHEN list_has_any(qtk, {V.RATIONALE_INTENT}) THEN ['rationale'] WHEN list_has_any(qtk, {V.EVIDENCE_INTENT}) THEN ['evidence', 'evidence_table'] ELSE [] END AS wanted
          FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{P}') AS qtk FROM benchmark)),
second AS (
  SELECT *, 0.60::DOUBLE * score / CASE WHEN max(score) OVER w > 0 THEN max(score) OVER w ELSE 1 END + 0.40::DOUBLE * coverage
            + CASE WHEN list_contains(wanted, content_type) THEN 0.20::DOUBLE ELSE 0 END AS rerank_score
  FROM cov JOIN types USING (query_id) WINDOW w AS (PARTITION BY query_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 10) DESC, is_current DESC, page, first_rank) AS rank FROM second)"""

QUERIES = {
    "tokenize_counts": (tokenize_counts, f"WITH {TOKENS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM toks) GROUP BY ALL) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS terms, max(tf) AS top_tf FROM p GROUP BY doc_id"),
    "term_stats": (term_stats, f"WITH {TOKENS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM toks) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 8) AS idf FROM p GROUP BY term"),
    "doc_lengths": (doc_lengths, f"WITH {TOKENS} SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS tokens, round(avg(dl), 6) AS mean, count(*) FILTER (WHERE dl = 0) AS empty FROM dls"),
    "bm25_topk": (bm25_topk, f"WITH {BM25} SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10"),
    "bm25_filtered": (bm25_filtered, f"WITH {BM25}, {ATTRIBUTES} SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm JOIN attrs USING (doc_id) WHERE lang IN ('fr', 'en') AND content_type IN ('recommendation', 'rationale') QUALIFY rank <= 5"),
    "dense_topk": (dense_topk, "WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings r, embeddings q WHERE q.vec_id % 100 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p QUALIFY rank <= 10"),
    "dense_rescaled": (dense_rescaled, "WITH p AS (SELECT q.vec_id AS query_id, greatest(0, least(1, (list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) + 1) / 2)) AS score FROM embeddings r, embeddings q WHERE q.vec_id % 100 = 0) SELECT query_id, round(max(score), 6) AS best, round(min(score), 6) AS worst, count(*) AS rows FROM p GROUP BY query_id"),
    "vector_units": (vector_units, "WITH n AS (SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, CAST(CASE WHEN n > 1e-12 THEN 1 ELSE 0 END AS DOUBLE) AS unit_norm FROM n"),
    "manifest_check": (manifest_check, "SELECT count(*) AS rows, CAST(max(len(embedding)) AS BIGINT) AS dimensions, count(*) FILTER (WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS not_unit, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (WHERE len(embedding) != (SELECT max(len(embedding)) FROM embeddings)) AS other_length FROM embeddings"),
    "hybrid_topk": (hybrid_topk, f"WITH {CAND} SELECT query_id, doc_id, round(base, 6) AS score, round(bm25_norm, 6) AS bm25_norm, round(dense, 6) AS dense, row_number() OVER (PARTITION BY query_id ORDER BY round(base, 6) DESC, doc_id) AS rank FROM based QUALIFY rank <= 10"),
    "hybrid_boosted": (hybrid_boosted, f"WITH {BOOSTED} SELECT query_id, doc_id, {FIRST} AS first_rank, round(score, 6) AS score, round(adjustment, 6) AS adjustment FROM boosted QUALIFY first_rank <= 20"),
    "anchor_coherence": (anchor_coherence, f"WITH {ANCHORED} SELECT query_id, doc_id, first_rank, round(score, 6) AS score, array_to_string(anchor_sites, ',') AS anchor_sites FROM firsts"),
    "rerank_topk": (rerank_topk, f"WITH {RERANKED} SELECT query_id, doc_id, rank, first_rank, round(rerank_score, 6) AS rerank_score, round(coverage, 6) AS coverage FROM ranked WHERE rank <= 10"),
    "engine_search": (engine_search, f"""WITH {ANCHORED.replace('0.55::DOUBLE * bm25_norm + 0.45::DOUBLE * dense AS base', '1.0::DOUBLE * bm25_norm AS base')}
        SELECT CAST(query_id AS VARCHAR) AS qid, 'retrieval_results' AS outcome, 'bm25' AS mode_used, 'hybrid search has no vectors: ranked by bm25' AS warning, CAST(first_rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score
        FROM firsts WHERE first_rank <= 5 UNION ALL SELECT qid, outcome, NULL, NULL, NULL, NULL, NULL FROM {values([(q, o) for q, _, o in STOPPED], 'qid', 'outcome')}"""),
    "engine_reranked": (engine_reranked, f"""WITH {RERANKED.replace('FROM attrs a LEFT JOIN embeddings', f"FROM (FROM attrs WHERE lang IN {(*FILTERS['sites'],)} AND content_type IN {(*FILTERS['types'],)}) a LEFT JOIN embeddings")}
        SELECT CAST(query_id AS VARCHAR) AS qid, 'retrieval_results' AS outcome, 'hybrid' AS mode_used, CAST(rank AS INTEGER) AS rank, CAST(first_rank AS INTEGER) AS first_rank, doc_id,
          round(rerank_score, 6) AS score, round(base, 6) AS base, round(coverage, 6) AS coverage FROM ranked WHERE rank <= 5"""),
    "search_results": (search_results, f"""WITH {RERANKED} SELECT query_id, rank, 'E' || rank AS label, doc_id, round(dense, 6) AS dense, round(bm25_norm, 6) AS bm25_norm,
        array_to_string(list_filter([CASE WHEN asked_evidence AND content_type IN ('evidence', 'evidence_table', 'rationale') THEN 'evidence-intent match' END,
          CASE WHEN NOT asked_evidence AND canonical THEN 'canonical current recommendation' END,
          CASE WHEN NOT asked_evidence AND NOT canonical AND is_current THEN 'current authoritative source' END,
          CASE WHEN list_has_any(sites, anchor_sites) THEN 'site coherence from top canonical match' END], lambda x: x IS NOT NULL), '; ') AS explanations,
        'Guideline · ' || source || ' · Recommendation ' || recommendation_id || ' · Page ' || page || ' · ' || CASE WHEN is_current THEN 'current' ELSE 'earlier' END AS citation
        FROM ranked WHERE rank <= 3"""),
}
