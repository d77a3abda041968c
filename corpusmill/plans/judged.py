"""Judging queries. Judgments are derived from line items: an order is a task, a line a pass of one of two judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations
from ..functions import text as T
from ..operators import judging
from ..sources import models
from .common import table

CRITERIA = ["claim_support", "citation_entailment", "overreach", "completeness", "refusal_quality"]


def _tasks(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, CRITERIA)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), kind.alias("criterion"))


def _judgments(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("judge"),
        F.col("l_linenumber").alias("pass"),
        F.when(F.col("l_orderkey") % 5 == 0, F.when(F.col("l_quantity") < 30, "SUPPORTED").when(F.col("l_quantity") < 40, "UNSUPPORTED").otherwise("CONTRADICTED")).otherwise(F.when(F.col("l_quantity") < 30, "YES").otherwise("NO")).alias("label"),
    )
    return rows


def judge_majority(spark, sf):
    return judging.majority(_judgments(spark, sf))


def judge_consensus(spark, sf):
    return judging.two_judges(_tasks(spark, sf), _judgments(spark, sf), "a", "b")


def judge_rates(spark, sf):
    c = judge_consensus(spark, sf)
    return c.groupBy("criterion").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.avg((~F.col("passed")).cast("double")), 4).alias("fail_rate"), F.count_if(F.col("label") == "UNCERTAIN").alias("uncertain"))


def judge_agreement(spark, sf):
    c = judge_consensus(spark, sf)
    return c.agg(F.round(F.avg(F.col("agree").cast("double")), 4).alias("agreement"), F.count("*").alias("tasks"))


def judge_labels(spark, sf):
    return judge_consensus(spark, sf).groupBy("criterion", "label").agg(F.count("*").alias("n"))


def _single(spark, sf, judge, name):
    first = _judgments(spark, sf).where(F.col("judge") == judge)
    return first.groupBy("task_id").agg(F.min(F.struct("pass", "label"))["label"].alias("label"))


def judge_escalation(spark, sf):
    return judging.escalated(_tasks(spark, sf), _single(spark, sf, "a", "la"), _single(spark, sf, "b", "lb"))


def escalation_report(spark, sf):
    e = judge_escalation(spark, sf)
    return e.agg(F.count("*").alias("tasks"), F.count_if("escalated").alias("escalated"), F.round(F.avg(F.col("agree").cast("double")), 4).alias("agreement"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


RAW_LABELS = ["SUPPORTED", "YES", "NO", "MAYBE", "UNSUPPORTED", None]


def judgment_validation(spark, sf):
    """Raw judgments by rule, many of them invalid; line items stand for answers."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", k, n).alias("task_id"), pick(CRITERIA, k % 5).alias("criterion"), pick(RAW_LABELS, n % 6).alias("label"),
        F.when(F.col("l_returnflag") != "R", "r").alias("reason"), F.when(F.col("l_linestatus") == "O", F.array(F.lit("C1"))).alias("claim_ids"),
    )
    return judging.valid(rows).groupBy("criterion", "label").agg(F.count("*").alias("n"), F.min("task_id").alias("first"))


def task_expand(spark, sf):
    """Tasks of every assistant turn: its sentences are claims, an even conversation's first is cited."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    cited = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("E1"))).otherwise(F.array().cast("array<string>"))
    claims = F.transform(T.sentences("text"), lambda s: F.struct(s.alias("claim"), cited.alias("labels")))
    packets = turns.select(F.concat_ws(".", "conv_id", "turn").alias("case_id"), F.when(F.col("conv_id") % 3 == 0, "refuse").otherwise("answer").alias("expected"), claims.alias("claims"))
    return judging.tasks(packets).groupBy("case_id", "criterion").agg(F.count("*").alias("n"), F.count("label").alias("settled"))


def _model(before: str, cite):
    """A stand-in for a model: repeats its prompt, and cites where `cite` says so."""
    return lambda: lambda prompts: [f"{before}{p}{' [E1]' if cite(p) else ''}" for p in prompts]


def generated_answers(spark, sf):
    """Answers of a model, with one bounded repair of those that cite nothing."""
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt"))
    out = models.generate(q, _model("Answer to: ", lambda p: len(p) % 2 == 1 or "7" in p))
    out = out.withColumn("repair_prompt", F.concat(F.lit("Cite: "), "prompt"))
    out = models.repaired(out, _model("", lambda p: True), ~F.col("answer").rlike(citations.CITATION))
    return out.select("item_id", "answer")


def human_rates(spark, sf):
    """Rates of human decisions; what doesn't apply is left out."""
    lab = table(spark, sf, "labels")
    said = lab.select(F.when(F.col("quality") == 1, " Yes ").otherwise("false").alias("ok"), F.when(F.col("doc_id") % 4 == 0, "N/A").when(F.col("toxic") == 1, "0").otherwise("TRUE").alias("current"))
    said = said.select(T.tri_state("ok").alias("ok"), T.tri_state("current").alias("current"))
    return said.agg(F.round(F.avg(F.col("ok").cast("double")), 4).alias("ok_rate"), F.round(F.avg(F.col("current").cast("double")), 4).alias("current_rate"), F.count("current").alias("applicable"))


def failure_types(spark, sf):
    """Failures that reviewers wrote, in any case and with any separator; events stand for reviews."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, "Wrong site; missing Age").when(k == 1, F.concat(F.lit("missing age|"), "event_type", F.lit(" , "))).when(k == 3, F.upper("event_type"))
    rows = table(spark, sf, "events").select(F.explode(F.split(said, "[,;|]")).alias("t"))
    rows = rows.select(F.replace(F.lower(F.trim("t")), F.lit(" "), F.lit("_")).alias("failure")).where("failure != ''")
    return rows.groupBy("failure").agg(F.count("*").alias("n"))


def review_queue(spark, sf):
    """Documents to review: a bad label, a failure, or any uncited claim among their sentences."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    uncited = F.exists(T.sentences("text"), lambda s: (F.length(s) > 400) & ~s.rlike(citations.CITATION))
    return lab.where((F.col("quality") == 0) | (F.col("toxic") == 1) | uncited).select("doc_id", "quality", "toxic")


_kind = f"{CRITERIA}[CAST(o_orderkey % 5 + 1 AS BIGINT)]"
_J = f"""tasks AS (SELECT o_orderkey AS task_id, {_kind} AS criterion FROM orders),
j AS (SELECT l_orderkey AS task_id, CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END AS judge, l_linenumber AS pass,
  CASE WHEN l_orderkey % 5 = 0 THEN CASE WHEN l_quantity < 30 THEN 'SUPPORTED' WHEN l_quantity < 40 THEN 'UNSUPPORTED' ELSE 'CONTRADICTED' END ELSE CASE WHEN l_quantity < 30 THEN 'YES' ELSE 'NO' END END AS label FROM lineitem),
c AS (SELECT task_id, judge, label, count(*) AS n, min(pass) AS f FROM j GROUP BY ALL),
m AS (SELECT task_id, judge, CASE WHEN n >= 2 THEN label ELSE 'UNCERTAIN' END AS label FROM c QUALIFY row_number() OVER (PARTITION BY task_id, judge ORDER BY n DESC, f, label DESC) = 1),
x AS (SELECT t.task_id, t.criterion, coalesce(a.label, 'UNCERTAIN') AS la, coalesce(b.label, 'UNCERTAIN') AS lb FROM tasks t LEFT JOIN m a ON a.task_id = t.task_id AND a.judge = 'a' LEFT JOIN m b ON b.task_id = t.task_id AND b.judge = 'b'),
y AS (SELECT task_id, criterion, CASE WHEN la = lb THEN la ELSE 'UNCERTAIN' END AS label FROM x),
z AS (SELECT *, label <> 'UNCERTAIN' AS agree, label = CASE criterion WHEN 'claim_support' THEN 'SUPPORTED' WHEN 'overreach' THEN 'NO' ELSE 'YES' END AS passed FROM y)"""
_E = f"""{_J}, one AS (SELECT task_id, judge, (min(struct_pack(p := pass, l := label))).l AS label FROM j GROUP BY ALL),
e0 AS (SELECT t.*, p.label AS la, s.label AS lb, CASE criterion WHEN 'claim_support' THEN 'SUPPORTED' WHEN 'overreach' THEN 'NO' ELSE 'YES' END AS want FROM tasks t JOIN (FROM one WHERE judge = 'a') p USING (task_id) LEFT JOIN (FROM one WHERE judge = 'b') s USING (task_id)),
e1 AS (SELECT *, la <> want AS escalated, CASE WHEN la = want THEN la WHEN la IS NOT DISTINCT FROM lb THEN la ELSE 'UNCERTAIN' END AS label FROM e0),
esc AS (SELECT task_id, criterion, escalated, label, CASE WHEN escalated THEN label <> 'UNCERTAIN' END AS agree, label = want AS passed FROM e1)"""
_raw = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in RAW_LABELS) + "]"

QUERIES = {
    "judge_majority": (judge_majority, f"WITH {_J} SELECT task_id, judge, label FROM m"),
    "judge_consensus": (judge_consensus, f"WITH {_J} SELECT * FROM z"),
    "judge_rates": (judge_rates, f"WITH {_J} SELECT criterion, count(*) AS n, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 4) AS pass_rate, round(avg(CASE WHEN passed THEN 0 ELSE 1 END), 4) AS fail_rate, count(*) FILTER (WHERE label = 'UNCERTAIN') AS uncertain FROM z GROUP BY criterion"),
    "judge_agreement": (judge_agreement, f"WITH {_J} SELECT round(avg(CASE WHEN agree THEN 1 ELSE 0 END), 4) AS agreement, count(*) AS tasks FROM z"),
    "judge_labels": (judge_labels, f"WITH {_J} SELECT criterion, label, count(*) AS n FROM z GROUP BY ALL"),
    "judge_escalation": (judge_escalation, f"WITH {_E} SELECT * FROM esc"),
    "escalation_report": (escalation_report, f"WITH {_E} SELECT count(*) AS tasks, count(*) FILTER (WHERE escalated) AS escalated, round(avg(CASE WHEN agree THEN 1 WHEN NOT agree THEN 0 END), 4) AS agreement, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 4) AS pass_rate FROM esc"),
    "judgment_validation": (judgment_validation, f"WITH v AS (SELECT l_orderkey || '-' || l_linenumber AS task_id, {CRITERIA}[CAST(l_orderkey % 5 + 1 AS BIGINT)] AS criterion, {_raw}[l_linenumber % 6 + 1] AS label, CASE WHEN l_returnflag <> 'R' THEN 'r' END AS reason, l_linestatus = 'O' AS ids FROM lineitem) SELECT criterion, label, count(*) AS n, min(task_id) AS first FROM v WHERE coalesce(CASE WHEN criterion = 'claim_support' THEN label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'CONTRADICTED') ELSE label IN ('YES', 'NO') END, false) AND reason IS NOT NULL AND (criterion <> 'overreach' OR ids) GROUP BY criterion, label"),
    "task_expand": (task_expand, """WITH s AS (SELECT conv_id || '.' || turn AS case_id, conv_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9•])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM conversations WHERE role = 'assistant')
        SELECT case_id, 'claim_support' AS criterion, n, 0 AS settled FROM s WHERE n > 0 UNION ALL SELECT case_id, 'citation_entailment', n, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE n END FROM s WHERE n > 0
        UNION ALL SELECT case_id, 'overreach', 1, 0 FROM s UNION ALL SELECT case_id, 'completeness', 1, 0 FROM s UNION ALL SELECT case_id, 'refusal_quality', 1, 0 FROM s WHERE conv_id % 3 = 0"""),
    "generated_answers": (generated_answers, "WITH p AS (SELECT item_id, text AS p FROM benchmark) SELECT item_id, CASE WHEN length(p) % 2 = 1 OR contains(p, '7') THEN 'Answer to: ' ELSE 'Cite: ' END || p || ' [E1]' AS answer FROM p"),
    "human_rates": (human_rates, "SELECT round(avg(quality), 4) AS ok_rate, round(avg(CASE WHEN doc_id % 4 <> 0 THEN 1 - toxic END), 4) AS current_rate, count(*) FILTER (WHERE doc_id % 4 <> 0) AS applicable FROM labels"),
    "failure_types": (failure_types, "WITH e AS (SELECT CASE event_id % 4 WHEN 0 THEN 'Wrong site; missing Age' WHEN 1 THEN 'missing age|' || event_type || ' , ' WHEN 3 THEN upper(event_type) END AS types FROM events), t AS (SELECT replace(lower(trim(unnest(regexp_split_to_array(types, '[,;|]')))), ' ', '_') AS failure FROM e) SELECT failure, count(*) AS n FROM t WHERE failure <> '' GROUP BY failure"),
    "review_queue": (review_queue, "WITH s AS (SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9•])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 400 AND NOT regexp_matches(x, '\\[E(\\d+)\\]'))) AS n FROM documents) SELECT doc_id, quality, toxic FROM labels JOIN s USING (doc_id) WHERE quality = 0 OR toxic = 1 OR n > 0"),
}
