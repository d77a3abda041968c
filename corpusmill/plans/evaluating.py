"""Evaluation queries: vector search over all rows, judged by gold from the rows' labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, guards
from ..operators import evaluation as E
from ..operators import index, search
from .common import ATTRIBUTES, table, with_attributes
from .search import BM25
from .texts import ASCII, BATTERY, _emerg, _scope

#: Gold by rule: a query's gold are rows of its own label; sites and types follow from the row as elsewhere.
K = 10


def _results(spark, sf, dims: int | None = None):
    """query_id, vec_id, rank, relevant; dims: score by the first components only (a second configuration)."""
    rows = table(spark, sf, "embeddings")
    if dims:
        rows = rows.withColumn("embedding", F.slice("embedding", 1, dims))
    top = search.dense_topk(rows, rows.where("vec_id % 100 = 0"), K + 1).where("query_id != vec_id")
    label = rows.select(F.col("vec_id"), F.col("label"))
    out = top.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)
    return out.select("query_id", "vec_id", "rank", (F.col("label") == F.col("gold")).alias("relevant"), "gold", "label")


def _queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("grp"))


def _metrics(per):
    r = lambda c, n: F.round(c, 4).alias(n)
    return [r(E.recall_at(1), "recall_at_1"), r(E.recall_at(5), "recall_at_5"), r(F.avg("p_at_3"), "precision_at_3"), r(F.avg("p_at_5"), "precision_at_5"), r(E.mrr(), "mrr")]


def recall_precision_mrr(spark, sf):
    per = E.per_query(_results(spark, sf), _queries(spark, sf))
    return per.agg(F.count("*").alias("queries"), *_metrics(per))


def metrics_by_group(spark, sf):
    per = E.per_query(_results(spark, sf), _queries(spark, sf)).join(_queries(spark, sf), "query_id")
    return per.groupBy("grp").agg(F.count("*").alias("queries"), *_metrics(per))


def precision_ceiling(spark, sf):
    """What precision at 3 could be with the gold that the corpus has, and the share of it that was reached."""
    q = _queries(spark, sf)
    gold = table(spark, sf, "embeddings").groupBy(F.col("label").alias("grp")).agg((F.count("*") - 1).alias("gold"))
    per = E.per_query(_results(spark, sf), q).join(q, "query_id").join(index.bounded(gold), "grp")
    ceiling = F.avg(F.least(F.col("gold"), F.lit(3)) / 3)
    return per.agg(F.round(ceiling, 4).alias("ceiling"), F.round(F.avg("p_at_3") / ceiling, 4).alias("adjusted"))


def _configurations(spark, sf):
    out = None
    for name, dims in (("full", None), ("half", 32), ("quarter", 16)):
        per = E.per_query(_results(spark, sf, dims), _queries(spark, sf))
        row = per.agg(*_metrics(per)).select(F.lit(name).alias("configuration"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def best_config(spark, sf):
    return E.best_configuration(_configurations(spark, sf), ["recall_at_5", "precision_at_3", "mrr"], "configuration")


def run_delta(spark, sf):
    """Metrics of a run less those of the full one."""
    c = _configurations(spark, sf)
    base = c.where("configuration = 'full'").select(*[F.col(x).alias(f"b_{x}") for x in c.columns])
    other = c.where("configuration != 'full'").crossJoin(F.broadcast(base))  # one row
    return other.select("configuration", *[F.round(F.col(x) - F.col(f"b_{x}"), 4).alias(x) for x in ("recall_at_5", "precision_at_3", "mrr")])


def noise_reasons(spark, sf):
    """Why results aren't gold, for each query and in rank order."""
    from pyspark.sql import Window

    at = with_attributes(table(spark, sf, "documents").drop("text")).select("doc_id", "sites", "content_type", "recommendation_id")
    out = _results(spark, sf).where("not relevant").join(at.withColumnRenamed("doc_id", "vec_id"), "vec_id")
    gold = at.select(F.col("doc_id").alias("query_id"), F.array("recommendation_id").alias("gold_ids"), F.col("sites").alias("gold_sites"), F.when(F.col("doc_id") % 200 == 0, F.array("content_type")).otherwise(F.array().cast("array<string>")).alias("gold_types"))
    out = out.join(gold, "query_id").withColumn("related_ids", F.array(F.concat(F.lit("1.1."), F.col("vec_id") % 50)))
    w = Window.partitionBy("query_id", "content_type", "label").orderBy("rank")
    out = out.withColumn("seen", F.row_number().over(w) > 1)
    return out.select("query_id", "rank", E.non_gold_reason().alias("reason"))


def canonical_top1(spark, sf):
    """Share of queries whose first result is relevant and current."""
    top = _results(spark, sf).where("rank = 1")
    return top.agg(F.round(F.avg(F.when(F.col("relevant") & (F.col("vec_id") % 2 == 0), 1.0).otherwise(0.0)), 4).alias("accuracy"), F.count("*").alias("checked"))


def _gold(spark, sf):
    """Gold of each question by rule: a record, an id and, for some, types and sites."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    none = F.array().cast("array<string>")
    return q.select(
        "query_id", F.array(F.col("query_id")).alias("gold_records"),
        F.array(F.concat(F.lit("1."), F.col("query_id") % 16 + 1, F.lit("."), F.col("query_id") % 50)).alias("gold_ids"),
        F.when(F.col("query_id") % 3 == 0, F.array(F.lit("evidence"), F.lit("rationale"))).otherwise(none).alias("gold_types"),
        F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de"))).alias("gold_sites"),
    )


def relevance(spark, sf):
    """The lexical results of each question judged by record, id, or type and site: first rank, precision, what it could be."""
    from .search import bm25_topk

    chunks = with_attributes(table(spark, sf, "documents").drop("text")).select("doc_id", "recommendation_id", "content_type", "sites")
    gold = _gold(spark, sf)
    found = bm25_topk(spark, sf).select("query_id", "doc_id", "rank").join(chunks, "doc_id").join(gold, "query_id")
    judged = found.select("query_id", "rank", E.relevant(gold_records="gold_records").alias("relevant"))
    per = E.per_query(judged, gold).join(E.gold_in_corpus(chunks, gold), "query_id")
    return per.select("query_id", F.col("first_rank").cast("int").alias("first_rank"), F.round("p_at_3", 6).alias("p_at_3"), F.round("p_at_5", 6).alias("p_at_5"), F.round(F.least("gold", F.lit(3)) / 3, 6).alias("ceiling"))


EXPECTED = [(q, "refuse" if q in ("s1", "s3", "a1") else "insufficient" if q.startswith("a") else "answer") for q, _ in BATTERY]


_expected = dict(EXPECTED)


def refusal_metrics(spark, sf):
    """Refusals by the scope guard among questions that should be refused, and among the others; items ask by number."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("item_id") % len(BATTERY) + 1).cast("int"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), pick([t for _, t in BATTERY]).alias("text"), pick([_expected[x] for x, _ in BATTERY]).alias("expected"))
    q = q.withColumn("outcome", F.coalesce(guards.outcome("text"), F.lit("retrieval_results"))).withColumn("refused", (F.col("outcome") == "scope_refusal").cast("double"))
    should = F.col("expected") == "refuse"
    return q.agg(F.round(F.avg(F.when(should, F.col("refused"))), 4).alias("correct_refusal"), F.round(F.avg(F.when(~should, F.col("refused"))), 4).alias("false_refusal"), F.count_if(F.col("outcome") == "emergency_redirect").alias("redirects"))


#: Labels as answers write them, and their one form; # stands for a number.
VARIANTS = [
    ("Refer now 【E#†L1-L5】 and later [E 3].", "Refer now [E#] and later [E3]."), ("**E#** – supports it", "[E#] – supports it"), ("Both (E5; E#) and [Evidence E1, E#].", "Both [E5] [E#] and [E1] [E#]."),
    ("Keep [E#] as is", "Keep [E#] as is"), ("Nothing here (see #)", "Nothing here (see #)"), ("E#: first", "[E#]: first"),
]
_pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))


def _answers(spark, sf):
    """Answers of assistants with labels by rule: all sentences of even conversations, the end of odd ones; four passages of which three exist."""
    t = table(spark, sf, "conversations").where("role = 'assistant'")
    cited = F.regexp_replace("text", F.lit(r"([.!?])(\s|$)"), F.concat(F.lit(" [E"), F.col("turn") % 4 + 1, F.lit("]$1$2")))
    heads = F.when(F.col("conv_id") % 3 == 0, "## Summary\n- ").when(F.col("conv_id") % 3 == 1, "| a | b |\n|---|---|\n").otherwise("")
    answer = F.concat(heads, F.when(F.col("conv_id") % 2 == 0, cited).otherwise(F.concat("text", F.lit(" [E1] [E2]"))))
    return t.select(F.concat_ws(".", "conv_id", "turn").alias("id"), answer.alias("answer"), F.lit(3).alias("available"))


def citation_labels(spark, sf):
    k = F.col("doc_id")
    answer = F.replace(_pick([a for a, _ in VARIANTS], k), F.lit("#"), (k % 9 + 1).cast("string"))
    return table(spark, sf, "documents").select("doc_id", citations.canonical_labels(answer).alias("answer"))


def claim_units(spark, sf):
    """Claim units of all answers, and of the same without labels."""
    own = _answers(spark, sf).select("id", "answer")
    turns = table(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws(".", F.lit("t"), "conv_id", "turn").alias("id"), F.col("text").alias("answer"))
    out = own.unionByName(turns).withColumn("u", citations.claim_units("answer"))
    return out.select("id", F.size("u").alias("units"), F.sha2(F.array_join("u", "\n"), 256).alias("digest"))


def citation_validation(spark, sf):
    a = _answers(spark, sf).withColumn("v", citations.validation("answer", "available"))
    return a.select("id", F.array_join("v.valid", ",").alias("valid"), F.array_join("v.invalid", ",").alias("invalid"), "v.units", "v.cited", "v.coverage", "v.passed", citations.answer_outcome("v").alias("outcome"))


def citation_metrics(spark, sf):
    a = _answers(spark, sf).withColumn("v", citations.validation("answer", "available"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return a.agg(rate("v.labels_ok").alias("label_validity"), rate("v.coverage").alias("coverage"), rate("v.passed").alias("release"), F.count_if(F.col("v.labels_ok") & ~F.col("v.coverage_ok")).alias("to_repair"))


def claim_split(spark, sf):
    return _answers(spark, sf).select("id", F.explode(citations.split_claims("answer")).alias("c")).select("id", "c.claim_id", "c.text", F.array_join("c.ranks", ",").alias("ranks"))


def evidence_blocks(spark, sf):
    """Per query, its results as one labelled text in rank order."""
    out = _results(spark, sf)
    line = F.concat(F.lit("[E"), F.col("rank"), F.lit("] vector "), F.col("vec_id"))
    per = out.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("r"))  # ten rows a query
    return per.select("query_id", F.array_join(F.col("r.line"), "\n").alias("evidence"))


_RES = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:{d}] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label AS gold, r.vec_id, r.label, round(list_dot_product(r.v, q.v), 6) AS cosine FROM e r, e q WHERE q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id),
self AS (SELECT q.vec_id AS query_id, round(list_dot_product(q.v, q.v), 6) AS own FROM e q WHERE q.vec_id % 100 = 0),
res AS (SELECT query_id, gold, vec_id, label, label = gold AS relevant, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p QUALIFY rank <= 10),
per AS (SELECT query_id, any_value(gold) AS grp, min(CASE WHEN relevant THEN rank END) AS first_rank, count(*) FILTER (WHERE relevant AND rank <= 3) / 3 AS p_at_3, count(*) FILTER (WHERE relevant AND rank <= 5) / 5 AS p_at_5 FROM res GROUP BY query_id)"""
_M = "round(avg(CASE WHEN first_rank <= 1 THEN 1 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END), 4) AS recall_at_5, round(avg(p_at_3), 4) AS precision_at_3, round(avg(p_at_5), 4) AS precision_at_5, round(avg(coalesce(1 / first_rank, 0)), 4) AS mrr"
_full = _RES.format(d=64)
# three configurations: each its own chain of relations
_conf = ", ".join(
    _RES.format(d=d).replace("e AS (", f"e{d} AS (", 1).replace("FROM e r, e q", f"FROM e{d} r, e{d} q").replace("FROM e q", f"FROM e{d} q")
    .replace("\np AS", f"\np{d} AS").replace("FROM p QUALIFY", f"FROM p{d} QUALIFY").replace("\nself AS", f"\nself{d} AS").replace("\nres AS", f"\nres{d} AS").replace("FROM res GROUP", f"FROM res{d} GROUP").replace("\nper AS", f"\nper{d} AS")
    for d in (64, 32, 16)
)
_conf += ", confs AS (" + " UNION ALL ".join(f"SELECT '{n}' AS configuration, {_M} FROM per{d}" for n, d in (("full", 64), ("half", 32), ("quarter", 16))) + ")"
_answer_sql = r"""an AS (SELECT conv_id || '.' || turn AS id, CASE conv_id % 3 WHEN 0 THEN '## Summary' || chr(10) || '- ' WHEN 1 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) ELSE '' END
  || CASE WHEN conv_id % 2 = 0 THEN regexp_replace(text, '([.!?])(\s|$)', ' [E' || (turn % 4 + 1) || ']\1\2', 'g') ELSE text || ' [E1] [E2]' END AS answer, 3 AS available FROM conversations WHERE role = 'assistant')"""

_strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_units = f"""{_answer_sql}, ua AS (SELECT id, answer FROM an UNION ALL SELECT 't.' || conv_id || '.' || turn, text FROM conversations WHERE role = 'assistant'),
ul AS (SELECT id, list_filter(list_transform(regexp_split_to_array(answer, '\\r\\n|\\r|\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM ua),
ui AS (SELECT id, list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(coalesce(l[i + 1], ''), '{citations.SEPARATOR}') AND NOT regexp_matches(l[i], '{citations.SEPARATOR}') AND NOT regexp_matches(l[i], '{citations.HEADING}')), lambda i: l[i]) AS k FROM ul),
us AS (SELECT id, flatten(list_transform(k, lambda x: CASE WHEN prefix(x, '|') AND suffix(x, '|') THEN [x] ELSE
  list_transform(string_split(regexp_replace({_strip("regexp_replace(x, '^(?:[-*+]\\s+|\\d+[.)]\\s+)', '')")}, '([.!?])\\s+([A-Z0-9*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {_strip('s')}) END)) AS u FROM ui),
uf AS (SELECT id, list_filter(u, lambda s: len(regexp_extract_all(regexp_replace(s, '\\[E(\\d+)\\]', '', 'g'), '{citations.WORD}')) >= 4) AS u FROM us)"""
_checked = f"""{_units}, lb AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[E(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)))) AS l FROM an),
ck AS (SELECT id, list_filter(l, lambda x: x >= 1 AND x <= available) AS good, list_filter(l, lambda x: NOT (x >= 1 AND x <= available)) AS bad, CAST(len(u) AS INTEGER) AS units,
  CAST(len(list_filter(u, lambda s: regexp_matches(s, '\\[E(\\d+)\\]'))) AS INTEGER) AS cited FROM lb JOIN uf USING (id)),
cv AS (SELECT id, array_to_string(good, ',') AS valid, array_to_string(bad, ',') AS invalid, units, cited, CASE WHEN units > 0 THEN round(cited / units, 4) ELSE 0 END AS coverage,
  len(good) > 0 AND len(bad) = 0 AS labels_ok, units > 0 AND cited = units AS coverage_ok FROM ck)"""

_hit = "g.query_id = a.doc_id OR g.gid = a.recommendation_id OR (list_contains(g.types, a.content_type) AND list_contains(g.gsites, a.lang))"
_gold_sql = """gold AS (SELECT item_id AS query_id, '1.' || CAST(item_id % 16 + 1 AS VARCHAR) || '.' || CAST(item_id % 50 AS VARCHAR) AS gid,
  CASE WHEN item_id % 3 = 0 THEN ['evidence', 'rationale'] ELSE [] END AS types, CASE WHEN item_id % 2 = 0 THEN ['en', 'fr'] ELSE ['de'] END AS gsites FROM benchmark)"""

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
QUERIES = {
    "relevance": (relevance, f"""WITH {BM25}, {ATTRIBUTES}, {_gold_sql},
        top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10),
        hit AS (SELECT query_id, rank FROM top JOIN attrs a USING (doc_id) JOIN gold g USING (query_id) WHERE {_hit}),
        n AS (SELECT g.query_id, count(*) AS n FROM gold g JOIN attrs a ON {_hit} GROUP BY 1),
        per AS (SELECT query_id, min(rank) AS f, count(*) FILTER (WHERE rank <= 3) AS h3, count(*) FILTER (WHERE rank <= 5) AS h5 FROM hit GROUP BY 1)
        SELECT query_id, CAST(f AS INTEGER) AS first_rank, round(coalesce(h3, 0) / 3, 6) AS p_at_3, round(coalesce(h5, 0) / 5, 6) AS p_at_5, round(least(coalesce(n, 0), 3) / 3, 6) AS ceiling
        FROM gold LEFT JOIN per USING (query_id) LEFT JOIN n USING (query_id)"""),
    "recall_precision_mrr": (recall_precision_mrr, f"WITH {_full} SELECT count(*) AS queries, {_M} FROM per"),
    "metrics_by_group": (metrics_by_group, f"WITH {_full} SELECT grp, count(*) AS queries, {_M} FROM per GROUP BY grp"),
    "precision_ceiling": (precision_ceiling, f"WITH {_full}, g AS (SELECT label AS grp, count(*) - 1 AS gold FROM embeddings GROUP BY 1) SELECT round(avg(least(gold, 3) / 3), 4) AS ceiling, round(avg(p_at_3) / avg(least(gold, 3) / 3), 4) AS adjusted FROM per JOIN g USING (grp)"),
    "best_config": (best_config, f"WITH {_conf} SELECT * FROM confs ORDER BY recall_at_5 DESC, precision_at_3 DESC, mrr DESC, configuration LIMIT 1"),
    "run_delta": (run_delta, f"WITH {_conf} SELECT c.configuration, round(c.recall_at_5 - b.recall_at_5, 4) AS recall_at_5, round(c.precision_at_3 - b.precision_at_3, 4) AS precision_at_3, round(c.mrr - b.mrr, 4) AS mrr FROM confs c, confs b WHERE b.configuration = 'full' AND c.configuration <> 'full'"),
    "noise_reasons": (noise_reasons, f"""WITH {_full}, {ATTRIBUTES}, n AS (SELECT r.query_id, r.rank, r.label, a.sites, a.content_type, '1.1.' || CAST(r.vec_id % 50 AS VARCHAR) AS related, g.recommendation_id AS gid, g.sites AS gs,
        CASE WHEN g.doc_id % 200 = 0 THEN [g.content_type] ELSE [] END AS gt, row_number() OVER (PARTITION BY r.query_id, a.content_type, r.label ORDER BY r.rank) > 1 AS seen
        FROM res r JOIN attrs a ON a.doc_id = r.vec_id JOIN attrs g ON g.doc_id = r.query_id WHERE NOT relevant)
        SELECT query_id, rank, CASE WHEN seen THEN 'duplicate_unit' WHEN gid = related THEN 'close_context_referencing_gold_id' WHEN NOT list_has_any(gs, sites) THEN 'wrong_cancer_site'
          WHEN len(gt) > 0 AND NOT list_contains(gt, content_type) THEN 'wrong_content_type' WHEN content_type IN ('recommendation', 'symptom_table') THEN 'same_site_alternative_unit' ELSE 'same_site_context' END AS reason FROM n"""),
    "canonical_top1": (canonical_top1, f"WITH {_full} SELECT round(avg(CASE WHEN relevant AND vec_id % 2 = 0 THEN 1 ELSE 0 END), 4) AS accuracy, count(*) AS checked FROM res WHERE rank = 1"),
    "refusal_metrics": (refusal_metrics, f"WITH questions AS (SELECT item_id AS qid, {_list([t for _, t in BATTERY])}[CAST(item_id % {len(BATTERY)} + 1 AS BIGINT)] AS text, {_list([_expected[x] for x, _ in BATTERY])}[CAST(item_id % {len(BATTERY)} + 1 AS BIGINT)] AS expected FROM benchmark), qa AS (SELECT qid, {ASCII} AS a FROM questions), {_scope}, {_emerg}, x AS (SELECT s.qid, expected, emergency, NOT emergency AND excluded <> '' AND selected = '' AS refused FROM scoped s JOIN emer USING (qid) JOIN (SELECT qid, expected FROM questions) USING (qid)) SELECT round(avg(CASE WHEN refused THEN 1 ELSE 0 END) FILTER (WHERE expected = 'refuse'), 4) AS correct_refusal, round(avg(CASE WHEN refused THEN 1 ELSE 0 END) FILTER (WHERE expected <> 'refuse'), 4) AS false_refusal, count(*) FILTER (WHERE emergency) AS redirects FROM x"),
    "citation_labels": (citation_labels, f"SELECT doc_id, replace({_list([b for _, b in VARIANTS])}[CAST(doc_id % {len(VARIANTS)} + 1 AS BIGINT)], '#', CAST(doc_id % 9 + 1 AS VARCHAR)) AS answer FROM documents"),
    "claim_units": (claim_units, f"WITH {_units} SELECT id, CAST(len(u) AS INTEGER) AS units, sha256(array_to_string(u, chr(10))) AS digest FROM uf"),
    "citation_validation": (citation_validation, f"WITH {_checked} SELECT id, valid, invalid, units, cited, coverage, labels_ok AND coverage_ok AS passed, CASE WHEN labels_ok AND coverage_ok THEN 'grounded_answer' ELSE 'generation_rejected' END AS outcome FROM cv"),
    "citation_metrics": (citation_metrics, f"WITH {_checked} SELECT round(avg(CASE WHEN labels_ok THEN 1 ELSE 0 END), 4) AS label_validity, round(avg(coverage), 4) AS coverage, round(avg(CASE WHEN labels_ok AND coverage_ok THEN 1 ELSE 0 END), 4) AS release, count(*) FILTER (WHERE labels_ok AND NOT coverage_ok) AS to_repair FROM cv"),
    "claim_split": (claim_split, f"WITH {_answer_sql}, s AS (SELECT id, string_split(regexp_replace(answer, '([.!?])\\s+([A-Z0-9*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM an), u AS (SELECT id, unnest(range(1, len(s) + 1)) AS i, trim(unnest(s), ' ' || chr(10)) AS s FROM s) SELECT id, 'C' || i AS claim_id, trim(regexp_replace(s, '\\[E(\\d+)\\]', '', 'g'), ' ' || chr(10)) AS text, array_to_string(regexp_extract_all(s, '\\[E(\\d+)\\]', 1), ',') AS ranks FROM u WHERE s <> ''"),
    "evidence_blocks": (evidence_blocks, f"WITH {_full} SELECT query_id, string_agg('[E' || rank || '] vector ' || vec_id, chr(10) ORDER BY rank) AS evidence FROM res GROUP BY query_id"),
}
