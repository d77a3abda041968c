"""Version linking queries: benchmark items stand for current records, documents for earlier ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import reconcile, windows
from ..operators.index import bounded
from ..store import stash
from .common import ATTRIBUTES, literal, table, texts, values, with_attributes


def _both(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return items, texts(spark, sf).select(F.col("doc_id").alias("id"), "text")


def jaccard_match(spark, sf):
    """How many documents share a term with each item: by its meaning, every such pair counts."""
    pairs = reconcile.shared_terms(*_both(spark, sf))
    return pairs.groupBy("left_id").agg(F.count("*").alias("candidates"), F.round(F.max("jaccard"), 6).alias("best"))


def best_match(spark, sf):
    return reconcile.best_by_terms(*_both(spark, sf), k=3).select("left_id", "right_id", "rank", F.round("jaccard", 6).alias("jaccard"))


def unmatched(spark, sf):
    """Items that no document matches with the least score."""
    matched = reconcile.best_by_terms(*_both(spark, sf), least=V.MATCH_LEAST).select("left_id")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("left_id")).join(matched, "left_id", "left_anti")


def _with_texts(spark, sf, best):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("left_id"), F.col("text").alias("current"))
    docs = texts(spark, sf).select(F.col("doc_id").alias("right_id"), F.col("text").alias("earlier"))
    # a few rows an item: sent to the documents, whose texts are not shuffled
    return docs.join(bounded(stash(best.join(items, "left_id"), "best-pairs")), "right_id")


def similarity_blend(spark, sf):
    """Each item's three best of all documents by the blended score, and what the score makes of them."""
    out = _with_texts(spark, sf, reconcile.best_blend(*_both(spark, sf), 3)).withColumn("structural", F.lit(False))
    out = reconcile.classify(out.withColumn("reasons", reconcile.difference_reasons("earlier", "current")))
    return out.select("left_id", "right_id", F.round("score", 6).alias("score"), "unmatched", "duplicate", "differs")


def version_diff(spark, sf):
    out = _with_texts(spark, sf, reconcile.best_by_terms(*_both(spark, sf)).select("left_id", "right_id"))
    return out.select("left_id", "right_id", F.array_join(T.clinical_numbers("earlier"), " ").alias("numbers"), F.size(reconcile.difference_reasons("earlier", "current")).alias("reasons"))


def match_terms(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(F.array_sort(T.match_terms("text")), " ").alias("terms"), F.length(T.match_form("text")).alias("form_chars"))


SECTIONS = [*V.STRUCTURE, "Elsewhere"]
_ids = values([(s, i + 1, x) for s, xs in V.STRUCTURE.items() for i, x in enumerate(xs)], "section", "ordinal", "matched_id")


def structural_match(spark, sf):
    """Documents stand for the rows of sections, their numbers for places."""
    k = F.col("doc_id")
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (k % len(SECTIONS) + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", section.alias("section"), F.when(k % 13 != 0, k % 5 + 1).cast("int").alias("ordinal"))
    return reconcile.structural_match(spark, rows).select("doc_id", "matched_id")


def prefix_join(spark, sf):
    """Documents whose recommendation id begins with the prefix of each section."""
    prefixes = literal(spark, [*V.SECTION_PREFIX.items()], "section string, prefix string")
    d = with_attributes(texts(spark, sf)).select("doc_id", "recommendation_id")
    out = windows.by_prefix(d, "recommendation_id", prefixes, "prefix")
    return out.groupBy("section").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _links(spark, sf):
    """Toxic-labelled documents linked to canonical ones of their source."""
    d = with_attributes(texts(spark, sf)).select(F.col("doc_id").alias("id"), F.array("source").alias("sites"), "canonical")
    marked = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return reconcile.links(d.join(marked, "id", "left_semi"), d.where("canonical"))


def support_links(spark, sf):
    """How many links each supporting document has, and the first."""
    return reconcile.linked(_links(spark, sf)).select("support_id", "n", "first")


def reciprocal_links(spark, sf):
    """The same links from the canonical side: how many, the first and the last, and all ids in order."""
    return reconcile.linked(_links(spark, sf), "current", ids=True).select("current_id", "n", "first", "last", F.array_join("ids", ",").alias("support_ids"))


def link_classes(spark, sf):
    """The same links by classes: which class links to which, and how many documents each has."""
    name = lambda c: F.array_join(c, ",").alias(c)
    return _links(spark, sf).classes.select(name("support_class"), name("current_class"), "support_n", "current_n", (F.col("support_n") * F.col("current_n")).alias("links"))


def version_classes(spark, sf):
    """Line items stand for matched pairs: the discount is the score."""
    score = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 8)
    reasons = F.array_repeat(F.lit("x"), (F.col("l_orderkey") % 3).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), (F.col("l_linenumber") % 2 == 0).alias("structural"), reasons.alias("reasons"))
    return reconcile.classify(rows).select("l_orderkey", "l_linenumber", "unmatched", "duplicate", "differs")


_form = "lower(replace(replace(text, '–', '-'), '‑', '-'))"
for _p in (V.TWO_WEEKS, V.YEAR, V.LONG_ID):
    _form = f"regexp_replace({_form}, '{_p}', '', 'g')"
_stops = "[" + ", ".join(f"'{w}'" for w in V.MATCH_STOPWORDS) + "]"
_terms = f"list_distinct(list_filter(regexp_extract_all({_form}, '{V.MATCH_TOKEN}'), lambda x: NOT list_contains({_stops}, x)))"
_J = f"""l AS (SELECT item_id AS left_id, {_terms} AS t FROM benchmark), r AS (SELECT doc_id AS right_id, {_terms} AS t FROM documents),
lu AS (SELECT left_id, len(t) AS ln, unnest(t) AS term FROM l), ru AS (SELECT right_id, len(t) AS rn, unnest(t) AS term FROM r),
j AS (SELECT left_id, right_id, count(*) / (ln + rn - count(*)) AS jaccard FROM lu JOIN ru USING (term) GROUP BY left_id, right_id, ln, rn),
b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(jaccard, 10) DESC, right_id) AS rank FROM j)"""
_nums = lambda c: f"list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({c}, '{V.TWO_WEEKS}', '', 'g'), '{V.YEAR}', '', 'g'), '{V.LONG_ID}', '', 'g'), '\\b\\d+(?:\\.\\d+)?\\b')))"
_acts = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{a}' END" for a, p in V.ACTIONS.items()) + "], lambda x: x IS NOT NULL)"
_links_sql = f"m AS (SELECT doc_id AS support_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), c AS (SELECT doc_id AS current_id, source FROM documents WHERE doc_id % 10 = 0), links AS (SELECT DISTINCT support_id, current_id FROM m JOIN c USING (source))"

QUERIES = {
    "jaccard_match": (jaccard_match, f"WITH {_J} SELECT left_id, count(*) AS candidates, round(max(jaccard), 6) AS best FROM j GROUP BY left_id"),
    "best_match": (best_match, f"WITH {_J} SELECT left_id, right_id, rank, round(jaccard, 6) AS jaccard FROM b WHERE rank <= 3"),
    "unmatched": (unmatched, f"WITH {_J} SELECT item_id AS left_id FROM benchmark LEFT JOIN (FROM b WHERE rank = 1) ON item_id = left_id WHERE coalesce(jaccard, 0) < 0.32"),
    "similarity_blend": (similarity_blend, None),
    "version_diff": (version_diff, f"WITH {_J}, t AS (SELECT left_id, right_id, d.text AS e, k.text AS c FROM b JOIN documents d ON doc_id = right_id JOIN benchmark k ON item_id = left_id WHERE rank = 1), x AS (SELECT *, {_nums('e')} AS en, {_nums('c')} AS cn, {_acts('e')} AS ea, {_acts('c')} AS ca FROM t) SELECT left_id, right_id, array_to_string(en, ' ') AS numbers, CASE WHEN en <> cn THEN 1 ELSE 0 END + CASE WHEN len(ea) > 0 AND len(ca) > 0 AND list_sort(ea) <> list_sort(ca) THEN 1 ELSE 0 END AS reasons FROM x"),
    "match_terms": (match_terms, f"SELECT doc_id, array_to_string(list_sort({_terms}), ' ') AS terms, CAST(length(array_to_string(regexp_extract_all({_form}, '{V.MATCH_TOKEN}'), ' ')) AS INTEGER) AS form_chars FROM documents"),
    "structural_match": (structural_match, f"WITH d AS (SELECT doc_id, {SECTIONS}[CAST(doc_id % {len(SECTIONS)} + 1 AS BIGINT)] AS section, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 5 + 1 END AS ordinal FROM documents) SELECT doc_id, matched_id FROM d LEFT JOIN {_ids.replace(' AS t(', ' AS s(')} USING (section, ordinal)"),
    "prefix_join": (prefix_join, f"WITH {ATTRIBUTES} SELECT section, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM attrs JOIN {values([*V.SECTION_PREFIX.items()], 'section', 'prefix')} ON starts_with(recommendation_id, prefix) GROUP BY section"),
    "support_links": (support_links, f"WITH {_links_sql} SELECT support_id, count(*) AS n, min(current_id) AS first FROM links GROUP BY support_id"),
    "reciprocal_links": (reciprocal_links, f"WITH {_links_sql} SELECT current_id, count(*) AS n, min(support_id) AS first, max(support_id) AS last, string_agg(CAST(support_id AS VARCHAR), ',' ORDER BY support_id) AS support_ids FROM links GROUP BY current_id"),
    "link_classes": (link_classes, f"WITH {_links_sql} SELECT source AS support_class, source AS current_class, count(DISTINCT support_id) AS support_n, count(DISTINCT current_id) AS current_n, count(*) AS links FROM links JOIN documents ON doc_id = current_id GROUP BY source"),
    "version_classes": (version_classes, "WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_discount * 8 END AS score, l_linenumber % 2 = 0 AS structural, l_orderkey % 3 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(score < 0.32::DOUBLE, true) AS unmatched, coalesce(score >= 0.62::DOUBLE, false) AS duplicate, coalesce(score >= 0.32::DOUBLE AND n > 0 AND (structural OR score >= 0.42::DOUBLE), false) AS differs FROM c"),
}
