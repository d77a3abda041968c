"""Ordered, ranged and aggregated queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, folds, judging, windows
from .common import ATTRIBUTES, literal, table, values, with_attributes


def segment_islands(spark, sf):
    """Conversations cut where the user speaks: turns, characters and first turn of each segment."""
    rows = windows.segments(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return rows.groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


def asof_marker(spark, sf):
    """Each event with its user's last error before it."""
    ev = table(spark, sf, "events")
    mark = F.when(F.col("event_type") == "error", F.col("event_id"))
    return windows.carried(ev, ["user_id"], ["ts", "event_id"], mark, "marker", -1).select("event_id", "marker")


BANDS = [("low", 0, 10), ("mid", 10, 50), ("wide", 5, 80), ("high", 80, 100000)]


def range_join_sections(spark, sf):
    bands = literal(spark, BANDS, "band string, lo int, hi int")
    out = windows.within(table(spark, sf, "events"), "value", bands, "lo", "hi")
    return out.groupBy("band", "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


def recent_500(spark, sf):
    rows = windows.latest(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 500)
    return rows.select("event_type", "event_id", "recency")


def latency_summary(spark, sf):
    """Two percentiles by nearest rank and the median of all values; the floor-rank percentile of the 500 latest."""
    ev = table(spark, sf, "events")
    nearest = lambda p: lambda n: F.greatest(F.ceil(n * p), F.lit(1))
    ranks = {"p50": nearest(0.5), "p95": nearest(0.95), "_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}
    per = windows.at_ranks(ev, ["event_type"], "value", ranks)
    per = per.select("event_type", "p50", "p95", F.round((F.col("_low") + F.col("_high")) / 2, 6).alias("median"))
    recent = windows.latest(ev, ["event_type"], [F.desc("ts"), F.desc("event_id")], 500)
    return per.join(recent.groupBy("event_type").agg(evaluation.floor_rank("value", 0.95).alias("recent_p95"), F.count("*").alias("recent")), "event_type")


def telemetry_snapshot(spark, sf):
    """Counters by type, with the share of errors; null where nothing was counted."""
    ev = table(spark, sf, "events")
    return ev.agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error", "view")], F.round(F.try_divide(F.count_if(F.col("event_type") == "error"), F.count("*")), 6).alias("error_rate"))


def seen_before(spark, sf):
    rows = windows.seen_before(table(spark, sf, "documents"), ["lang", "text"], "doc_id")
    return rows.select("doc_id", "seen")


#: A table of contents by rule: documents are its entries, twenty to a work.
_toc = "(SELECT 'g' || (doc_id // 20) AS document, doc_id AS ord, CAST(doc_id * 7 % 4 + 1 AS INTEGER) AS level, lang || ' ' || doc_id AS title, CAST(doc_id % 20 + 1 AS INTEGER) AS page FROM documents)"


def _toc_rows(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("g"), F.floor(k / 20)).alias("document"), k.alias("ord"), (k * 7 % 4 + 1).cast("int").alias("level"),
        F.concat("lang", F.lit(" "), k).alias("title"), (k % 20 + 1).cast("int").alias("page"),
    )


def toc_parents(spark, sf):
    out = folds.parents(_toc_rows(spark, sf))
    return out.select("document", "ord", F.array_join("parents", " > ").alias("parents"))


def section_ends(spark, sf):
    return folds.section_ends(_toc_rows(spark, sf), 30)


def word_lines(spark, sf):
    """Words set by rule (line items stand for words, their parts' numbers for pages) grouped to lines."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("page"), (F.col("l_quantity") * 1.5).alias("top"), F.col("l_extendedprice").alias("x0"), F.concat("l_returnflag", "l_linenumber").alias("text")
    )
    return folds.word_lines(rows, ["page"])


def seeded_order(spark, sf):
    """Labels in a reproducible random order: their places in it."""
    return judging.shuffled(table(spark, sf, "labels").select("doc_id"), "doc_id", "12").select("doc_id", "place")


def reference_cutoff(spark, sf):
    """Lines of each document before its first licence line."""
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("lines"), F.size(windows.before_marker(lines, "(?i)licen[sc]e")).alias("kept"))


def anchored_interval(spark, sf):
    """Lines from a document's first shouted or tabled line up to its next plain one."""
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.size(windows.between_anchors(lines, r"[|!]", r"^[^|!]*$")).alias("n"))


def page_stats(spark, sf):
    n = F.length("html")
    return table(spark, sf, "pages").agg(F.count("*").alias("pages"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("chars"), F.count_if(n == 0).alias("blank"))


def counts_by_source_type(spark, sf):
    return with_attributes(table(spark, sf, "documents")).groupBy("source", "content_type").agg(F.count("*").alias("n"))


def counts_exploded(spark, sf):
    d = with_attributes(table(spark, sf, "documents")).withColumn("site", F.explode(F.array_distinct(F.concat("sites", F.array("source")))))
    return d.groupBy("site").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def coverage_report(spark, sf):
    d = with_attributes(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("canonical")).alias("canonical"), F.count_if(F.col("is_current")).alias("current"),
        F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.length("text") < 40).alias("short"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
    )


def distinct_types(spark, sf):
    d = with_attributes(table(spark, sf, "documents"))
    return d.agg(F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("types"))


def point_lookup(spark, sf):
    """The row of one key; the filter reaches the scan."""
    return table(spark, sf, "documents").where(F.col("doc_id") == 17).select("doc_id", "lang", "source", "n_chars")


def metadata_map(spark, sf):
    """Properties of events as a map without nulls, and a heading path without nulls."""
    props = F.from_json("props", "map<string,string>")
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & (v != "[]"))
    path = F.array_compact(F.array("event_type", F.when(F.col("value") > 50, F.lit("high"))))
    return table(spark, sf, "events").select("event_id", F.size(kept).alias("keys"), kept["k"].alias("k"), F.array_join(path, " > ").alias("path"))


def example_rows(spark, sf):
    """The first document of each type and language."""
    d = with_attributes(table(spark, sf, "documents"))
    return d.groupBy("content_type", "lang").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("x")).select("content_type", "lang", "x.doc_id", "x.source")


def pending_work(spark, sf):
    passes = literal(spark, [("a", 1), ("a", 2), ("b", 1)], "judge string, pass int")
    work = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task")).crossJoin(F.broadcast(passes))
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("judge"), F.least("l_linenumber", F.lit(2)).cast("int").alias("pass"))
    return judging.pending(work, done, ["task", "judge", "pass"])


def orphan_check(spark, sf):
    lab, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id")
    return lab.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


def set_operations(spark, sf):
    """Ids labelled good, and toxic: union, both, difference, and whether the sets are equal."""
    lab = table(spark, sf, "labels")
    good, toxic = lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    out = n(good.unionByName(toxic), "bag").crossJoin(n(good.intersect(toxic), "common")).crossJoin(n(good.exceptAll(toxic), "only_good"))
    return out.crossJoin(n(good.union(toxic).distinct(), "either")).select("*", ((F.col("common") == F.col("either"))).alias("equal"))


def missing_ids(spark, sf):
    """Ids expected by language (the labelled ones) that aren't among those found (the good ones)."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    per = lab.groupBy("lang").agg(F.collect_set("doc_id").alias("expected"), F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("found"))
    return per.select("lang", F.size(F.array_except("expected", "found")).alias("missing"))


_win = "PARTITION BY event_type ORDER BY ts DESC, event_id DESC"
QUERIES = {
    "segment_islands": (segment_islands, "WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations) SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS turns, min(turn) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY conv_id, segment"),
    "asof_marker": (asof_marker, "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS marker FROM events"),
    "range_join_sections": (range_join_sections, f"SELECT band, event_type, count(*) AS n, round(max(value), 6) AS top FROM events JOIN {values(BANDS, 'band', 'lo', 'hi')} ON value BETWEEN lo AND hi GROUP BY band, event_type"),
    "recent_500": (recent_500, f"SELECT event_type, event_id, row_number() OVER ({_win}) AS recency FROM events QUALIFY recency <= 500"),
    "latency_summary": (latency_summary, f"WITH a AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1), r AS (SELECT event_type, value FROM events QUALIFY row_number() OVER ({_win}) <= 500), l AS (SELECT event_type, list_sort(list(value)) AS v FROM r GROUP BY 1) SELECT a.*, v[greatest(1, CAST(floor(len(v) * 0.95) AS BIGINT))] AS recent_p95, len(v) AS recent FROM a JOIN l USING (event_type)"),
    "telemetry_snapshot": (telemetry_snapshot, "SELECT count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'view') AS n_view, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events"),
    "seen_before": (seen_before, "SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) > 1 AS seen FROM documents"),
    "toc_parents": (toc_parents, f"WITH t AS (SELECT * FROM {_toc} AS x), a AS (SELECT x.document, x.ord, p.ord AS po, p.title FROM t x LEFT JOIN t p ON p.document = x.document AND p.ord < x.ord AND p.level < x.level AND NOT EXISTS (SELECT 1 FROM t m WHERE m.document = x.document AND m.ord > p.ord AND m.ord < x.ord AND m.level <= p.level)) SELECT document, CAST(ord AS BIGINT) AS ord, coalesce(string_agg(title, ' > ' ORDER BY po), '') AS parents FROM a GROUP BY document, ord"),
    "section_ends": (section_ends, f"WITH t AS (SELECT * FROM {_toc} AS x) SELECT document, CAST(ord AS BIGINT) AS ord, level, title, page, coalesce((SELECT n.page - 1 FROM t n WHERE n.document = t.document AND n.ord > t.ord AND n.level <= t.level ORDER BY n.ord LIMIT 1), 30) AS page_end FROM t"),
    "word_lines": (word_lines, """WITH RECURSIVE w AS (SELECT CAST(l_partkey AS VARCHAR) AS page, l_quantity * 1.5 AS top, l_extendedprice AS x0, l_returnflag || l_linenumber AS text,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_extendedprice, l_returnflag || l_linenumber) AS i FROM lineitem),
        r AS (SELECT page, i, 0 AS line, top AS head, x0, text FROM w WHERE i = 1
          UNION ALL SELECT w.page, w.i, CASE WHEN abs(r.head - w.top) <= 2 THEN r.line ELSE r.line + 1 END, CASE WHEN abs(r.head - w.top) <= 2 THEN r.head ELSE w.top END, w.x0, w.text FROM r JOIN w ON w.page = r.page AND w.i = r.i + 1)
        SELECT page, line, string_agg(text, ' ' ORDER BY x0, text) AS text FROM r GROUP BY page, line"""),
    "reference_cutoff": (reference_cutoff, "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, len(l) AS n, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)licen[sc]e')), true) AS p FROM l) SELECT doc_id, CAST(n AS INTEGER) AS lines, CAST(CASE WHEN p > 0 THEN p - 1 ELSE n END AS INTEGER) AS kept FROM p"),
    "anchored_interval": (anchored_interval, "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), a AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '[|!]')), true) AS a FROM l), r AS (SELECT doc_id, CASE WHEN a > 0 THEN l[a:] END AS r FROM a), b AS (SELECT doc_id, list_position(list_transform(r, lambda x: NOT regexp_matches(x, '[|!]')), true) AS b FROM r) SELECT doc_id, CAST(CASE WHEN b > 0 THEN b - 1 END AS INTEGER) AS n FROM b"),
    "page_stats": (page_stats, "SELECT count(*) AS pages, CAST(min(length(html)) AS INTEGER) AS least, CAST(max(length(html)) AS INTEGER) AS most, CAST(sum(length(html)) AS BIGINT) AS chars, count(*) FILTER (WHERE html = '') AS blank FROM pages"),
    "counts_by_source_type": (counts_by_source_type, f"WITH {ATTRIBUTES} SELECT source, content_type, count(*) AS n FROM attrs GROUP BY ALL"),
    "counts_exploded": (counts_exploded, "SELECT site, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT unnest([lang, source]) AS site, n_chars FROM documents) GROUP BY site"),
    "coverage_report": (coverage_report, f"WITH {ATTRIBUTES} SELECT a.lang, count(*) AS documents, count(*) FILTER (WHERE canonical) AS canonical, count(*) FILTER (WHERE is_current) AS current, count(quality) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE length(a.text) < 40) AS short, min(n_chars) AS least, max(n_chars) AS most FROM attrs a JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY a.lang"),
    "distinct_types": (distinct_types, f"WITH {ATTRIBUTES} SELECT array_to_string(list_sort(list(DISTINCT content_type)), ',') AS types FROM attrs"),
    "point_lookup": (point_lookup, "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17"),
    "metadata_map": (metadata_map, "SELECT event_id, CAST(len(list_filter(json_keys(props), lambda k: json_extract_string(props, k) IS NOT NULL)) AS INTEGER) AS keys, json_extract_string(props, 'k') AS k, event_type || CASE WHEN value > 50 THEN ' > high' ELSE '' END AS path FROM events"),
    "example_rows": (example_rows, f"WITH {ATTRIBUTES} SELECT content_type, lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM attrs GROUP BY ALL"),
    "pending_work": (pending_work, "SELECT o_orderkey AS task, judge, pass FROM orders, (VALUES ('a', 1), ('a', 2), ('b', 1)) AS p(judge, pass) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END = judge AND least(l_linenumber, 2) = pass)"),
    "orphan_check": (orphan_check, "SELECT count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "set_operations": (set_operations, "WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), t AS (SELECT doc_id FROM labels WHERE toxic = 1), n AS (SELECT (SELECT count(*) FROM g) + (SELECT count(*) FROM t) AS bag, (SELECT count(*) FROM (FROM g INTERSECT FROM t)) AS common, (SELECT count(*) FROM (FROM g EXCEPT ALL FROM t)) AS only_good, (SELECT count(*) FROM (FROM g UNION FROM t)) AS either) SELECT *, common = either AS equal FROM n"),
    "missing_ids": (missing_ids, "SELECT lang, CAST(count(DISTINCT doc_id) - count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) AS INTEGER) AS missing FROM labels JOIN documents USING (doc_id) GROUP BY lang"),
    "seeded_order": (seeded_order, "SELECT doc_id, row_number() OVER (ORDER BY md5('12:' || doc_id), doc_id) AS place FROM labels"),
}
