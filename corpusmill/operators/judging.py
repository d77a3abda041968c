"""Tasks for judges, their majority and consensus, and rates that fail closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..store import fresh
from .windows import numbered


def majority(judgments: DataFrame) -> DataFrame:
    """task_id, judge, label: the most frequent label if at least two passes gave it, of equals the one seen first; else UNCERTAIN."""
    counts = judgments.groupBy("task_id", "judge", "label").agg(F.count("*").alias("n"), F.min("pass").alias("first"))
    top = counts.groupBy("task_id", "judge").agg(F.max(F.struct("n", (-F.col("first")).alias("k"), "label")).alias("top"))
    return top.select("task_id", "judge", F.when(F.col("top.n") >= 2, F.col("top.label")).otherwise("UNCERTAIN").alias("label"))


def passes(criterion="criterion", label="label"):
    c, x = F.col(criterion), F.col(label)
    return F.when(c == "claim_support", x == "SUPPORTED").when(c == "overreach", x == "NO").otherwise(x == "YES")


def consensus(first, second):
    """The label if both agree on a certain one, else UNCERTAIN."""
    same = F.col(first).eqNullSafe(F.col(second)) & (F.col(first) != "UNCERTAIN")
    return F.when(same, F.col(first)).otherwise("UNCERTAIN")


def two_judges(tasks: DataFrame, judgments: DataFrame, a: str, b: str) -> DataFrame:
    """task_id, criterion, label, agree, passed by the majorities of two judges."""
    m = majority(judgments)
    per = m.groupBy("task_id").agg(F.max(F.when(F.col("judge") == a, F.col("label"))).alias("la"), F.max(F.when(F.col("judge") == b, F.col("label"))).alias("lb"))
    out = tasks.join(per, "task_id", "left").withColumn("la", F.coalesce("la", F.lit("UNCERTAIN"))).withColumn("lb", F.coalesce("lb", F.lit("UNCERTAIN")))
    out = out.withColumn("label", consensus("la", "lb")).withColumn("agree", F.col("label") != "UNCERTAIN")
    return out.withColumn("passed", passes()).select("task_id", "criterion", "label", "agree", "passed")


def escalated(tasks: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """A primary label that passes stands; one that fails must be shared by the secondary judge."""
    p = primary.select("task_id", F.col("label").alias("la"))
    s = secondary.select("task_id", F.col("label").alias("lb"))
    out = tasks.join(p, "task_id").join(s, "task_id", "left").withColumn("escalated", ~passes(label="la"))
    out = out.withColumn("label", F.when(F.col("escalated"), consensus("la", "lb")).otherwise(F.col("la")))
    out = out.withColumn("agree", F.when(F.col("escalated"), F.col("label") != "UNCERTAIN"))
    return out.withColumn("passed", passes()).select("task_id", "criterion", "escalated", "label", "agree", "passed")


def valid(judgments: DataFrame) -> DataFrame:
    """Judgments whose label their criterion allows and that give a reason (and claim ids, for overreach)."""
    allowed = F.when(F.col("criterion") == "claim_support", F.col("label").isin(V.SUPPORT_LABELS)).otherwise(F.col("label").isin(V.YES_NO))
    ids = (F.col("criterion") != "overreach") | F.col("claim_ids").isNotNull()
    return judgments.where(F.coalesce(allowed, F.lit(False)) & F.col("reason").isNotNull() & ids)


def tasks(packets: DataFrame) -> DataFrame:
    """task_id, criterion, case_id, claim_id, label (set where no judge is needed) from packets: case_id, expected, claims (array of struct claim, labels)."""
    claims = packets.select("case_id", F.posexplode("claims").alias("i", "c")).withColumn("claim_id", F.concat(F.lit("C"), F.col("i") + 1))
    empty = F.size(F.coalesce(F.col("c.labels"), F.array().cast("array<string>"))) == 0
    name = lambda k: F.concat_ws("_", "case_id", "claim_id", F.lit(k))
    none = F.lit(None).cast("string")
    per_claim = claims.select("case_id", "claim_id", F.explode(F.array(
        F.struct(name("claim_support").alias("task_id"), F.lit("claim_support").alias("criterion"), none.alias("label")),
        F.struct(name("citation_entailment").alias("task_id"), F.lit("citation_entailment").alias("criterion"), F.when(empty, "NO").alias("label")),
    )).alias("t")).select("t.task_id", "t.criterion", "case_id", "claim_id", "t.label")
    kinds = F.when(F.col("expected") == "refuse", F.array(*map(F.lit, ["overreach", "completeness", "refusal_quality"]))).otherwise(F.array(F.lit("overreach"), F.lit("completeness")))
    per_case = packets.select("case_id", F.explode(kinds).alias("criterion"))
    per_case = per_case.select(F.concat_ws("_", "case_id", "criterion").alias("task_id"), "criterion", "case_id", none.alias("claim_id"), none.alias("label"))
    return per_claim.unionByName(per_case)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def shuffled(rows: DataFrame, key: str, seed: str = "") -> DataFrame:
    """rows with place, from 1, in a reproducible random order: that of the md5 of the seed and their key (a unique one)."""
    hash_ = fresh(rows.columns, "_hash")
    out = rows.withColumn(hash_, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return numbered(out, [], [hash_, key], "place").drop(hash_)
