"""Mixing sources to target weights.

Words are counted per source (one partial aggregate, so a hot source costs its group one row a task),
targets and repetition rates follow from the source table, and each document is emitted floor(rate)
times plus once more if a number seeded by its id's hash is below the rate's fraction. Rows that share an id draw apart,
by their texts' hash and their number among equal rows.

Defined cases: a null text or one without words has size 0 and is emitted like any other document of its
source (it takes no words); a null source is a source of its own, last in the order; a source without words
has target 0 and rate 0; rows with the same doc_id, null ones and whole repeats too, each draw a number of their own;
an empty table gives an empty result; other columns pass through. A column named like one of the
operator's own (size, source_size, target, rate, copies, taken, copy_no) is replaced by it.

Scale: ids are shuffled to find those that repeat (two longs a row); documents aren't, but for those that share an id (and
what a filter of a fixed size takes for such). The source table has a row per source; it is broadcast up to
common.BROADCAST_ROWS rows, else joined by a shuffle that AQE splits for hot sources. Its order and running
sums need all its rows in one task, a row per source and not per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered
from .common import bounded, fresh, sieved, stash, table

WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "rate", "copies", "taken", "copy_no")


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: the words in text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, weight, target: share of all words, dealt by weight, at most `most` times a source's words.

    Filling by rising cap/weight: with the k sources of least cap/weight at their caps, the level of the others is
    (share - caps) / weights left; the first source whose part at that level is within its cap fixes the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(order))
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(int(most)))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    whole = Window.partitionBy()
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level falls no more once a source is free, so the first free row's level holds for all that follow
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(whole)["level"]
    per = per.withColumn("level", first)
    part = F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", "weight", F.coalesce(part, F.lit(0.0)).alias("target"))


def draw(name, seed: str = "mix"):
    """A number in [0, 1) from 52 bits of the md5 of the seed and a name."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def text_hash(text: str = "text"):
    """60 bits of the md5 of a text (null: the empty one)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def with_draw(rows: DataFrame, hash_: str, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """rows (key, source and hash_, their texts' hash) with __draw, a number in [0, 1) for each.

    A row draws by its id. Of rows that share an id (null is one too) the first by text hash and number draws so, each
    other by id, text hash and its number among the rows of that id and text, by source. The numbers come from ranges and
    a table of offsets, so a crowd of any size spans many tasks; rows that tie are alike, so draws don't follow the layout.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    many = rows.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("__n"), F.min(hash_).alias("__first"))
    many = stash(many.where("__n > 1").select("__id", "__first"), "mix-repeated")
    if not many.limit(1).count():
        return rows.withColumn("__draw", draw(name, seed))
    alone, shared = sieved(rows, F.xxhash64(key), many, F.xxhash64("__id"))
    shared = shared.join(bounded(many), F.col(key).eqNullSafe(F.col("__id")), "left").drop("__id")
    shared = numbered(shared, [key, hash_], [F.col("source").asc_nulls_last()], "__nth")
    first = F.col("__first").isNull() | ((F.col("__first") == F.col(hash_)) & (F.col("__nth") == 1))
    later = F.concat_ws(":", name, F.col(hash_).cast("string"), F.col("__nth").cast("string"))
    shared = shared.withColumn("__draw", draw(F.when(first, name).otherwise(later), seed)).drop("__first", "__nth")
    return alone.withColumn("__draw", draw(name, seed)).unionAll(shared)


def mix_sized(sized: DataFrame, targets: DataFrame, hash_: str, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """sized (key, source, size and hash_, the texts' hash) with source_size, target, rate, copies and taken."""
    t = targets.select(F.col("source").alias("__of"), "source_size", "target")
    out = with_draw(sized.drop("source_size", "target", "rate", "copies", "taken"), hash_, key, seed)
    out = out.join(bounded(t), F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of")
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    extra = (F.col("__draw") < F.col("rate") - F.floor("rate")).cast("long")
    out = out.withColumn("copies", F.floor("rate") + extra).drop("__draw")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with copy_no from 1."""
    own = {c: fresh(docs.columns, f"mix_{c}") for c in docs.columns if c.startswith("__")}  # set aside
    hash_ = "__text_hash"
    sized = with_size(docs.drop(*OWN).withColumnsRenamed(own)).withColumn(hash_, text_hash())
    targets = stash(source_targets(sized, weights, share, most), "mix-targets")
    taken = mix_sized(sized, targets, hash_, seed=seed).drop(hash_)
    out = taken.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.withColumnsRenamed({b: a for a, b in own.items()})


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stash(with_size(docs).select("doc_id", "source", "size", text_hash().alias("__text_hash")), "mix-sizes")
    out = mix_sized(sized, stash(source_targets(sized), "mix-targets"), "__text_hash")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), o AS (
  SELECT *, min(h) OVER (PARTITION BY doc_id) AS least, row_number() OVER (PARTITION BY doc_id, h ORDER BY source ASC NULLS LAST) AS k FROM d
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][CAST((nth - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 2 AS cap FROM p
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lev
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, lev * weight <= cap AS free FROM l
), m AS (
  SELECT lev AS level FROM f WHERE free ORDER BY CAST(cap AS DOUBLE) / weight, nth LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(CASE WHEN free THEN (SELECT level FROM m) * weight ELSE CAST(cap AS DOUBLE) END, 0) AS target FROM f
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN h = least AND k = 1 THEN '' ELSE ':' || h || ':' || k END), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM o d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, source, size, source_size, target, rate, copies, size * copies AS taken FROM c
"""
