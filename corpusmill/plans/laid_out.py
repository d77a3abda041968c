"""Layout, record and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import layout
from ..sources import files, images, models
from .common import ATTRIBUTES, literal, table, texts, with_attributes
from .texts import SITE_TEXTS, _glue, _head, _sites

#: What laid-out lines say; orders stand for lines, and their numbers give place, font and text by rule.
SAID = [
    "Header", "Big title", "Clinical question: what", "is known", "Table 3: results", "row one", "row two", "Refer adults for a scan",
    "within days. [new 2015] Offer a test", "to all others [2005]", "Consider nothing", "Consider a third test for adults with many symptoms that last longer than a month and recur",
    "Footer", "Quality of the evidence", "was low", "Evidence statements", "in the clinic [amended 2015]", "1. A paper",
]
_said = "CASE WHEN o_orderkey % 540 = 17 THEN 'References' ELSE " + str(SAID) + "[CAST(o_orderkey % 18 + 1 AS BIGINT)] END"
_l = f"""l AS (SELECT 'd' AS document, 's' || (o_custkey % 97) AS section, CAST(o_orderkey // 1500 + 1 AS INTEGER) AS page, 40.0::DOUBLE + (o_orderkey * 7 % 38) * 20 + (o_orderkey % 3) * 0.2::DOUBLE AS y,
  [60.0::DOUBLE, 260.0::DOUBLE, 530.0::DOUBLE][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS x, {_said} AS text, [9.0::DOUBLE, 12.0::DOUBLE, 10.0::DOUBLE, 10.5::DOUBLE][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS size,
  CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 = 1 THEN 'Sans-Bold' ELSE 'Regular' END AS font, o_orderkey AS ord FROM orders)"""
_furniture = "(y < 52 OR y > 748 OR x > 525)"


def _lines(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    d = table(spark, sf, "orders").select(
        F.lit("d").alias("document"), F.concat(F.lit("s"), F.col("o_custkey") % 97).alias("section"), (F.floor(k / 1500) + 1).cast("int").alias("page"),
        (F.lit(40.0) + (k * 7 % 38) * 20 + (k % 3) * F.lit(0.2)).alias("y"), pick([60.0, 260.0, 530.0], k % 3).alias("x"),
        F.when(k % 540 == 17, "References").otherwise(pick(SAID, k % 18)).alias("text"), pick([9.0, 12.0, 10.0, 10.5], k % 4).alias("size"),
        F.when((k % 3 == 1) | (k % 4 == 1), "Sans-Bold").otherwise("Regular").alias("font"), k.alias("ord"),
    )
    return d.withColumn("fonts", F.array("font")).withColumn("height", F.lit(800.0))


def line_filters(spark, sf):
    return _lines(spark, sf).select("ord", layout.furniture("y", "x", "height").alias("furniture"), layout.boxed().alias("boxed"))


def line_dedup(spark, sf):
    return layout.distinct_lines(_lines(spark, sf)).select("document", "ord")


def line_modes(spark, sf):
    out = layout.modes(layout.distinct_lines(_lines(spark, sf)).where(~layout.furniture("y", "x", "height")))
    return out.groupBy("section", "record", "mode").agg(F.min("ord").alias("first"), F.count("*").alias("lines"), F.min("page").alias("page"))


def boxed_recommendations(spark, sf):
    """Lines are split at update marks, then folded to records."""
    rows = _lines(spark, sf).where(layout.boxed() & (F.col("page") > 1)).select("section", "ord", "page", F.posexplode(layout.split_at_update("text")).alias("part", "text"))
    return layout.recommendations(rows, ["section"], ["ord", "part"])


def page_sections(spark, sf):
    return layout.page_sections(_lines(spark, sf).where(~layout.furniture("y", "x", "height"))).select("page", "title", F.length("text").alias("chars"))


def bullet_prefixes(spark, sf):
    """List marks of documents' lines rewritten; how many lines change."""
    d = texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    new = F.regexp_replace(F.regexp_replace("x", r"^o ", "- "), r"^•(\S)", "• $1")
    return d.withColumn("new", new).groupBy("doc_id").agg(F.count_if(F.col("new") != F.col("x")).alias("changed"), F.count("*").alias("lines"))


def nearest_parent(spark, sf):
    """Documents under a path of titles, some without a numbered one."""
    k = F.col("doc_id")
    own = F.array(F.lit("Guide"), F.concat(F.lit("1."), k % 3, F.lit(" "), "lang"), F.when(k % 2 == 0, F.concat(F.lit("1."), k % 7, F.lit(" "), "source")), F.lit("Refer"))
    parents = F.when(k % 11 == 0, F.array(F.lit("Guide"))).otherwise(F.array_compact(own))
    return table(spark, sf, "documents").select("doc_id", layout.nearest_parent(parents).alias("parent"))


def semibold_words(spark, sf):
    """The words of part names in the heavier of two fonts, which every other word has."""
    words = F.transform(F.split("p_name", " "), lambda w, i: F.struct(w.alias("text"), F.when(i % 2 == 0, "Sans-SemiBold").otherwise("Sans").alias("font")))
    return table(spark, sf, "part").select("p_partkey", layout.semibold(words).alias("words"))


def page_enrichment(spark, sf):
    """Pages with the columns of their source, as one table."""
    p = table(spark, sf, "pages").select("page_id", "url")
    new = p.where(F.col("url").startswith("https")).withColumns({"version": F.lit("current"), "authority": F.lit("primary")})
    old = p.where(~F.col("url").startswith("https")).withColumns({"version": F.lit("earlier"), "authority": F.lit("supporting")})
    return new.unionByName(old)


def scope_selection(spark, sf):
    """Documents in scope by a listed language, an id's prefix or a listed id, and by which of these first."""
    d = with_attributes(table(spark, sf, "documents"))
    listed = literal(spark, [("1.3.7",), ("1.9.11",)], "recommendation_id string").withColumn("hit", F.lit(True))
    d = d.join(F.broadcast(listed), "recommendation_id", "left")
    why = F.when(F.col("lang").isin("fr", "de"), "site").when(F.col("recommendation_id").startswith("1.15."), "prefix").when(F.col("hit"), "id")
    return d.withColumn("why", why).where("why is not null").select("doc_id", "why")


def row_validity(spark, sf):
    """Tabled lines of documents: valid rows have three cells, none empty; the others are counted as diagnostics."""
    d = texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").contains("|"))
    cells = F.transform(F.split("x", r"\|"), lambda c: F.trim(c))
    ok = (F.size(cells) == 3) & F.forall(cells, lambda c: c != "")
    return d.select("doc_id", ok.alias("ok")).groupBy("doc_id").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("bad"))


def minimum_length(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.count_if(n >= layout.LEAST).alias("kept"), F.count_if(n >= layout.TRAILING).alias("trailing"), F.count("*").alias("n"))


def heading_exists(spark, sf):
    """Which excluded labels some title of the documents' first lines holds."""
    labels = literal(spark, [("licence",), ("license",), ("the",), ("zzz",)], "label string")
    titles = texts(spark, sf).select(F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    hits = titles.select(*[F.contains("title", F.lit(x)).alias(x) for x in ("licence", "license", "the", "zzz")])
    found = hits.agg(F.array_compact(F.array(*[F.when(F.max(x), F.lit(x)) for x in hits.columns])).alias("found"))
    return labels.crossJoin(F.broadcast(found)).select("label", F.array_contains("found", F.col("label")).alias("found"))  # one row


def used_lines(spark, sf):
    """Lines that no benchmark text has used already: how many of each document's."""
    used = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("k")).distinct()
    d = texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("x")).withColumn("k", F.sha2("x", 256))
    return d.join(used, "k", "left_anti").groupBy("doc_id").agg(F.count("*").alias("left"))


def provisional_metrics(spark, sf):
    """Rates over all claims, over cited ones, and the cases to review; labels stand for verdicts."""
    k = F.col("doc_id")
    failures = F.when(k % 5 == 0, F.array(F.lit("tone"))).when(k % 5 == 1, F.array().cast("array<string>"))
    v = table(spark, sf, "labels").select(
        (F.col("quality") == 1).alias("ok"), F.when(k % 3 != 0, F.col("toxic") == 0).alias("current"), (k % 4).alias("claims"),
        F.when(F.col("quality") == 1, k % 4).otherwise(k % 2).alias("supported"), failures.alias("failures"),
    )
    flag = ~F.col("ok") | (F.col("supported") < F.col("claims")) | (F.size(F.coalesce("failures", F.array().cast("array<string>"))) > 0)
    return v.agg(
        F.count("*").alias("cases"), F.sum("claims").alias("claims"), F.round(F.sum("supported") / F.sum("claims"), 4).alias("support"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("behaviour"),
        F.round(F.avg(F.col("current").cast("double")), 4).alias("current"), F.count_if(flag).alias("review"),
    )


def verdict_lookup(spark, sf):
    """Documents with their label's verdict, an empty one where there is none."""
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, F.array(F.lit("good"))), F.array().cast("array<string>")).alias("v")).select("doc_id", F.array_join("v", ",").alias("verdict"))


def support_examples(spark, sf):
    """For each source, its first supporting document by type, page and id."""
    d = with_attributes(table(spark, sf, "documents")).where(F.col("content_type").isin("evidence", "rationale"))
    order = F.struct(F.when(F.col("content_type") == "evidence", 0).otherwise(1).alias("p"), "page", "doc_id")
    return d.groupBy("source").agg(F.min(order).alias("x")).select("source", "x.doc_id", "x.page")


def freeze_id(spark, sf):
    """One digest over the sources' names and digests, in order of name (a row a source).

    A source's digest is over the sums of three parts of its documents' digests, so no task gathers its documents.
    """
    d = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    per = d.groupBy("source").agg(F.concat_ws(":", part(1), part(13), part(25)).alias("h"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "h"))), lambda x: F.concat(x["source"], x["h"])), ""), 256).alias("freeze_id"))


def oversize_units(spark, sf):
    """Documents above the chunk limit, which stay whole where they are canonical."""
    d = with_attributes(texts(spark, sf)).withColumn("tokens", F.size(T.tokens("text")))
    return d.where(F.col("tokens") > 700).select("doc_id", "tokens", F.col("canonical").alias("stays_whole"))


def report_lines(spark, sf):
    """Plain-text lines of a report: counts by language, then by type."""
    d = with_attributes(table(spark, sf, "documents"))
    a = d.groupBy("lang").count().select(F.format_string("lang %s: %d", "lang", "count").alias("line"))
    return a.unionByName(d.groupBy("content_type").count().select(F.format_string("type %s: %d", "content_type", "count").alias("line")))


def handoff(spark, sf):
    """Turns that may be handed to search: a supported kind and a query of three characters at least."""
    t = table(spark, sf, "conversations")
    ok = (F.col("role") != "system") & (F.length(F.trim("text")) >= 3)
    return t.groupBy("role").agg(F.count_if(ok).alias("handed"), F.count("*").alias("n"))


def fenced_json(spark, sf):
    """Model answers freed of code fences and parsed, null where there is no object; events' properties stand for answers."""
    e = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.col("props"))
    t = t.when(F.col("event_id") % 4 == 2, "no json").otherwise('```\n{"k": null}\n```')
    return e.select("event_id", F.get_json_object(models.unfenced(t), "$.k").alias("k"))


def prompts(spark, sf):
    """The five judges' prompts of each question: its text is the claim, two documents are its passages, its first word the answer."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    one = lambda i: d.select((F.col("doc_id") - i).alias("item_id"), F.struct(F.lit(f"[E{i + 1}]").alias("label"), F.concat(F.lit("Guide, document "), "doc_id").alias("citation"), "text").alias(f"e{i}"))
    q = q.join(one(0), "item_id", "left").join(one(1), "item_id", "left")
    q = q.withColumn("evidence", F.array_compact(F.array("e0", "e1"))).withColumn("cited", F.slice("evidence", 2, 1))
    q = q.withColumn("claim", F.concat(F.lit("C1: "), "question")).withColumn("answer", F.split("question", " ")[0])
    q = q.withColumn("claims", F.when(F.col("item_id") % 3 == 0, F.array(F.struct(F.lit("C1").alias("claim_id"), F.col("question").alias("claim"))))).withColumn("expected", F.lit("answer"))
    made = [F.struct(F.lit(c).alias("criterion"), getattr(P, c)().alias("prompt")) for c in P.CRITERIA]
    out = q.select("item_id", F.explode(F.array(*made)).alias("p")).select("item_id", "p.criterion", "p.prompt")
    return out.select("item_id", "criterion", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("digest"))


def table_texts(spark, sf):
    """The three-line text of table rows; parts stand for rows."""
    return table(spark, sf, "part").select("p_partkey", T.table_text("p_name", "p_type", "p_brand").alias("text"))


def table_rows(spark, sf):
    """Whole table rows that name a site; parts stand for rows, some of them cut or with a cell missing."""
    k = F.col("p_partkey")
    cancers = F.element_at(F.array(*map(F.lit, SITE_TEXTS)), (k % len(SITE_TEXTS) + 1).cast("int"))
    cells = F.when(k % 13 == 0, F.array("p_name", cancers)).otherwise(F.array(F.col("p_name"), F.when(k % 11 != 0, cancers), F.col("p_brand")))
    out = layout.table_rows(table(spark, sf, "part").select("p_partkey", cells.alias("cells")))
    return out.select("p_partkey", F.array_join("sites", ",").alias("sites"), F.sha2("text", 256).alias("digest"))


def freeze_chain(spark, sf):
    """One digest over listed files' names and digests, in the order of the list; nations stand for files."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("path"), F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("digest"))
    return files.chained_digest(n)


def image_problems(spark, sf):
    """Why images aren't taken; pages stand for uploads, some of them in the right form."""
    k = F.col("page_id")
    png = F.unhex(F.lit("89504E470D0A1A0A"))
    data = F.when(k % 6 == 0, F.base64(F.concat(png, F.encode("url", "UTF-8")))).when(k % 6 == 1, F.base64(F.encode("url", "UTF-8"))).when(k % 6 == 2, F.lit("no base64!")).when(k % 6 == 3, F.lit("")).when(k % 6 == 4, F.base64(F.concat(png, F.encode(F.repeat("url", 30), "UTF-8"))))
    kind = F.when(k % 5 == 0, "image/gif").otherwise("IMAGE/png")
    return table(spark, sf, "pages").select("page_id", images.problem(kind, F.regexp_replace(data, "[\r\n]", ""), 500).alias("problem"))


def configuration(spark, sf):
    """What a client may choose from, as rows of a name and a value."""
    rows = [("mode", m) for m in ("bm25", "dense", "hybrid")] + [("site", x) for x in V.SELECTED_SITES] + [("candidates", str(V.CANDIDATES))]
    return literal(spark, rows, "name string, value string")


_boxed = "x >= 250 AND size BETWEEN 9 AND 10.6 AND font LIKE '%Bold%'"
_modes = f"""{_l}, dd AS (SELECT l.* FROM l JOIN (SELECT document, min(ord) AS ord FROM l GROUP BY document, page, round_even(y, 0), round_even(x, 0), text) USING (document, ord)),
gg AS (SELECT *, max(CASE WHEN text = 'References' THEN 1 ELSE 0 END) OVER (PARTITION BY section ORDER BY ord) AS gone FROM dd WHERE NOT {_furniture}),
ss AS (SELECT *, CASE WHEN starts_with(text, 'Clinical question') THEN 'clinical_question' WHEN text IN ('Clinical evidence', 'Evidence statement', 'Evidence statements', 'Cost-effectiveness evidence') THEN 'evidence'
  WHEN regexp_matches(text, '{layout.TABLE_TITLE}') THEN 'evidence_table' WHEN {' OR '.join(f"starts_with(text, '{r}')" for r in layout.RATIONALE)} THEN 'rationale' END AS st FROM gg WHERE gone = 0),
mm AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'clinical_context') AS mode FROM ss),
bb AS (SELECT *, CASE WHEN st IS NOT NULL OR coalesce(page <> lag(page) OVER w AND lag(mode) OVER w IN ('evidence_table', 'rationale'), false) THEN 1 ELSE 0 END AS begins FROM mm WINDOW w AS (PARTITION BY section ORDER BY ord)),
rr AS (SELECT *, sum(begins) OVER (PARTITION BY section ORDER BY ord) AS record FROM bb)"""
# a recursion over a section's lines: the open text, its first and last page, and what a line closes
_folded = f"""{_l}, b0 AS (SELECT section, ord, page, text, regexp_extract(text, '{layout.UPDATE_MARKER}') AS mark FROM l WHERE {_boxed} AND page > 1),
b1 AS (SELECT *, CASE WHEN mark <> '' THEN instr(text, mark) + length(mark) - 1 END AS upto FROM b0), b2 AS (SELECT *, trim(substr(text, upto + 1)) AS rest FROM b1),
b3 AS (SELECT section, ord, page, 0 AS part, CASE WHEN mark <> '' AND rest <> '' THEN trim(substr(text, 1, upto)) ELSE text END AS text FROM b2 UNION ALL SELECT section, ord, page, 1, rest FROM b2 WHERE mark <> '' AND rest <> ''),
b4 AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ord, part) AS i FROM b3),
st AS (
  SELECT section, CAST(0 AS BIGINT) AS i, '' AS t, 0 AS first, 0 AS last, '' AS done FROM b4 WHERE i = 1
  UNION ALL
  SELECT section, i, CASE WHEN ends THEN '' ELSE now END, f, page, CASE WHEN ends THEN now ELSE '' END FROM (
    SELECT *, regexp_matches(now, '{layout.UPDATE_MARKER}') AS ends FROM (
      SELECT b.section, b.i, b.page, CASE WHEN s.t <> '' AND b.page <= s.last + 1 THEN s.first ELSE b.page END AS f,
             CASE WHEN s.t <> '' AND b.page <= s.last + 1 THEN s.t || ' ' || b.text WHEN regexp_matches(b.text, '{layout.ACTION_START}') THEN b.text ELSE '' END AS now
      FROM st s JOIN b4 b ON b.section = s.section AND b.i = s.i + 1))
),
cut AS (SELECT section, i, first AS page, last AS page_end, done AS text FROM st WHERE done <> ''
  UNION ALL SELECT section, st.i + 1, first, last, t FROM st JOIN (SELECT section, max(i) AS n FROM b4 GROUP BY section) USING (section) WHERE length(t) >= {layout.TRAILING} AND st.i = n)"""
_pq = f"""q AS (SELECT item_id, text AS question FROM benchmark), e AS (SELECT doc_id, 'Guide, document ' || doc_id || chr(10) || text AS x FROM documents),
w AS (SELECT q.*, string_split(question, ' ')[1] AS answer, CASE WHEN a.x IS NOT NULL THEN ['[E1] | ' || a.x] ELSE [] END || CASE WHEN b.x IS NOT NULL THEN ['[E2] | ' || b.x] ELSE [] END AS ev
  FROM q LEFT JOIN e a ON a.doc_id = item_id LEFT JOIN e b ON b.doc_id = item_id + 1),
z AS (SELECT *, CASE WHEN len(ev) > 0 THEN array_to_string(ev, chr(10) || chr(10)) ELSE 'No passage was cited.' END AS evidence, coalesce(ev[2], 'No passage was cited.') AS cited,
  CASE WHEN item_id % 3 = 0 THEN 'C1: ' || question ELSE 'No claim was made.' END AS claims FROM w)"""
_sq = lambda x: "'" + x.replace("'", "''") + "'"
_parts = {
    "claim_support": [("Question", "question"), ("Claim", "'C1: ' || question"), ("Passages", "evidence")],
    "citation_entailment": [("Claim", "'C1: ' || question"), ("Cited passages", "cited")],
    "overreach": [("Question", "question"), ("Answer", "answer"), ("Claims", "claims"), ("Passages", "evidence")],
    "completeness": [("Expected behaviour", "'answer'"), ("Question", "question"), ("Answer", "answer"), ("Passages", "evidence")],
    "refusal_quality": [("Question", "question"), ("Reply", "answer")],
}
_prompts = " UNION ALL ".join(
    f"SELECT item_id, '{c}' AS criterion, {_sq(P.RULES + chr(10) * 2 + 'Criterion ' + c + ': ' + P.CRITERIA[c])}" + "".join(f" || {_sq(chr(10) * 2 + t + ':' + chr(10))} || {x}" for t, x in parts) + " AS p FROM z"
    for c, parts in _parts.items()
)
_fixed = lambda x: f"trim(regexp_replace({_glue.replace('text', x)}, '[ \\t]+', ' ', 'g'))"
_cells = "list_transform(string_split(x, '|'), lambda c: trim(c))"
_xl = "x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)"
QUERIES = {
    "line_filters": (line_filters, f"WITH {_l} SELECT ord, y < 52 OR y > 748 OR x > 525 AS furniture, x >= 250 AND size BETWEEN 9 AND 10.6 AND font LIKE '%Bold%' AS boxed FROM l"),
    "line_dedup": (line_dedup, f"WITH {_l} SELECT document, min(ord) AS ord FROM l GROUP BY document, page, round_even(y, 0), round_even(x, 0), text"),
    "line_modes": (line_modes, f"WITH {_modes} SELECT section, CAST(record AS BIGINT) AS record, mode, min(ord) AS first, count(*) AS lines, min(page) AS page FROM rr GROUP BY section, record, mode"),
    "boxed_recommendations": (boxed_recommendations, f"WITH RECURSIVE {_folded} SELECT section, row_number() OVER (PARTITION BY section ORDER BY i) AS ordinal, page, page_end, text FROM cut"),
    "page_sections": (page_sections, f"WITH {_l}, f AS (SELECT * FROM l WHERE NOT (y < 52 OR y > 748 OR x > 525)) SELECT page, coalesce(arg_min(text, ord) FILTER (WHERE font LIKE '%Bold%' AND size >= 11), 'Untitled') AS title, CAST(sum(length(text)) + count(*) - 1 AS INTEGER) AS chars FROM f GROUP BY page"),
    "bullet_prefixes": (bullet_prefixes, f"WITH {_xl} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(x, '^o |^•\\S')) AS changed, count(*) AS lines FROM x GROUP BY doc_id"),
    "nearest_parent": (nearest_parent, "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '1.' || (doc_id % 7) || ' ' || source ELSE '1.' || (doc_id % 3) || ' ' || lang END AS parent FROM documents"),
    "page_enrichment": (page_enrichment, "SELECT page_id, url, CASE WHEN url LIKE 'https%' THEN 'current' ELSE 'earlier' END AS version, CASE WHEN url LIKE 'https%' THEN 'primary' ELSE 'supporting' END AS authority FROM pages"),
    "scope_selection": (scope_selection, f"WITH {ATTRIBUTES}, w AS (SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN 'site' WHEN starts_with(recommendation_id, '1.15.') THEN 'prefix' WHEN recommendation_id IN ('1.3.7', '1.9.11') THEN 'id' END AS why FROM attrs) SELECT * FROM w WHERE why IS NOT NULL"),
    "row_validity": (row_validity, f"WITH {_xl}, o AS (SELECT doc_id, len({_cells}) = 3 AND len(list_filter({_cells}, lambda c: c = '')) = 0 AS ok FROM x WHERE contains(x, '|')) SELECT doc_id, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS bad FROM o GROUP BY doc_id"),
    "minimum_length": (minimum_length, "SELECT role, count(*) FILTER (WHERE length(text) >= 40) AS kept, count(*) FILTER (WHERE length(text) >= 80) AS trailing, count(*) AS n FROM conversations GROUP BY role"),
    "heading_exists": (heading_exists, "SELECT label, EXISTS (SELECT 1 FROM documents WHERE contains(lower(string_split(text, chr(10))[1]), label)) AS found FROM (VALUES ('licence'), ('license'), ('the'), ('zzz')) AS t(label)"),
    "used_lines": (used_lines, f"WITH {_xl} SELECT doc_id, count(*) AS left FROM x WHERE x NOT IN (SELECT text FROM benchmark) GROUP BY doc_id".replace("AS left", 'AS "left"')),
    "provisional_metrics": (provisional_metrics, "SELECT count(*) AS cases, CAST(sum(doc_id % 4) AS BIGINT) AS claims, round(sum(CASE WHEN quality = 1 THEN doc_id % 4 ELSE doc_id % 2 END) / sum(doc_id % 4), 4) AS support, round(avg(CASE WHEN quality = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END), 4) AS behaviour, round(avg(CASE WHEN doc_id % 3 <> 0 THEN 1 - toxic END), 4) AS current, count(*) FILTER (WHERE quality <> 1 OR CASE WHEN quality = 1 THEN doc_id % 4 ELSE doc_id % 2 END < doc_id % 4 OR doc_id % 5 = 0) AS review FROM labels"),
    "verdict_lookup": (verdict_lookup, "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)"),
    "support_examples": (support_examples, f"WITH {ATTRIBUTES} SELECT source, doc_id, page FROM attrs WHERE content_type IN ('evidence', 'rationale') QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN content_type = 'evidence' THEN 0 ELSE 1 END, page, doc_id) = 1"),
    "freeze_id": (freeze_id, "WITH h AS (SELECT source, sha256(text) AS h FROM documents), s AS (SELECT source, concat_ws(':', CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS VARCHAR)) AS h FROM h GROUP BY source) SELECT sha256(string_agg(source || h, '' ORDER BY source)) AS freeze_id FROM s"),
    "oversize_units": (oversize_units, f"WITH {ATTRIBUTES}, n AS (SELECT doc_id, canonical AS stays_whole, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS INTEGER) AS tokens FROM attrs) SELECT * FROM n WHERE tokens > 700"),
    "report_lines": (report_lines, f"WITH {ATTRIBUTES} SELECT 'lang ' || lang || ': ' || count(*) AS line FROM attrs GROUP BY lang UNION ALL SELECT 'type ' || content_type || ': ' || count(*) FROM attrs GROUP BY content_type"),
    "handoff": (handoff, "SELECT role, count(*) FILTER (WHERE role <> 'system' AND length(trim(text)) >= 3) AS handed, count(*) AS n FROM conversations GROUP BY role"),
    "fenced_json": (fenced_json, "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events"),
    "prompts": (prompts, f"WITH {_pq}, p AS ({_prompts}) SELECT item_id, criterion, CAST(length(p) AS INTEGER) AS chars, sha256(p) AS digest FROM p"),
    "semibold_words": (semibold_words, "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w, i: i % 2 = 1), ' ') AS words FROM part"),
    "table_texts": (table_texts, "SELECT p_partkey, 'Symptom and specific features: ' || p_name || chr(10) || 'Possible cancer: ' || p_type || chr(10) || 'Actions: ' || p_brand AS text FROM part"),
    "table_rows": (table_rows, f"""WITH c AS (SELECT p_partkey, p_name, p_brand, {_fixed(f"{SITE_TEXTS}[CAST(p_partkey % {len(SITE_TEXTS)} + 1 AS BIGINT)]")} AS cancers FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0),
        l AS (SELECT *, replace(lower({_head.replace('text', 'cancers')}), 'gall bladder', '') AS low FROM c), x AS (SELECT *, array_to_string(list_filter([{_sites}], lambda x: x IS NOT NULL), ',') AS sites FROM l)
        SELECT p_partkey, sites, sha256('Symptom and specific features: ' || {_fixed('p_name')} || chr(10) || 'Possible cancer: ' || cancers || chr(10) || 'Actions: ' || {_fixed('p_brand')}) AS digest FROM x WHERE sites <> ''"""),
    "freeze_chain": (freeze_chain, "SELECT sha256(string_agg(n_name || sha256(n_nationkey || '|' || n_name), '' ORDER BY n_nationkey)) AS digest FROM nation"),
    "image_problems": (image_problems, "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unsupported_type' WHEN page_id % 6 = 2 THEN 'invalid_base64' WHEN page_id % 6 IN (3, 5) THEN 'empty' WHEN page_id % 6 = 4 AND strlen(url) * 30 + 8 > 500 THEN 'too_large' WHEN page_id % 6 = 1 THEN 'wrong_content' END AS problem FROM pages"),
    "configuration": (configuration, "SELECT * FROM (VALUES ('mode', 'bm25'), ('mode', 'dense'), ('mode', 'hybrid'), ('site', 'lung'), ('site', 'colorectal'), ('site', 'oesophageal'), ('site', 'stomach'), ('site', 'pancreatic'), ('site', 'bladder'), ('site', 'renal'), ('candidates', '20')) AS t(name, value)"),
}
