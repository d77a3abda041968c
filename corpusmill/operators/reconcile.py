"""Linking an earlier version of a corpus to its current one, without merging wording."""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import ratio
from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.dense import release
from ..store import stash
from .index import bounded, exploded, in_blocks


def shared_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, jaccard of every pair that shares a term. left, right: id, text.

    Pairs come from an equi-join on terms (the smaller side's terms are broadcast up to a bound), never from a cross join.
    """
    terms = lambda df, k: df.select(F.col("id").alias(f"{k}_id"), T.match_terms("text").alias("terms")).withColumn(f"{k}_n", F.size("terms"))
    a = exploded(terms(left, "left"), ["left_id", "left_n"], "terms")
    b = exploded(terms(right, "right"), ["right_id", "right_n"], "terms")
    # dealt by the exploded side's row once: the pairs' counts need no further shuffle
    both = b.repartition("right_id").join(bounded(a), "term").groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count("*").alias("shared"))
    return both.select("left_id", "right_id", (F.col("shared") / (F.col("left_n") + F.col("right_n") - F.col("shared"))).alias("jaccard"))


def best_match(scored: DataFrame, score: str = "jaccard", k: int = 1) -> DataFrame:
    """The k best of each left_id with a positive score; ties go to the smaller right_id."""
    w = Window.partitionBy("left_id").orderBy(F.round(score, 10).desc(), "right_id")
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rarest terms of a text by which its first candidates are found.
SEEDS = 3


def _verified(ranked: DataFrame, b: DataFrame) -> DataFrame:
    """left_id, right_id, jaccard of the pairs that share a term of the prefix and may reach the floor.

    ranked: left_id, term, n, at, floor and prefix, how many terms (by at) are in it. Pairs are counted by the prefix's
    terms; only for those that would reach the floor if they shared all the others too are the others looked up.
    """
    ranked = stash(ranked, "prefixes")
    others = ranked.groupBy("left_id").agg(F.collect_list(F.when(F.col("at") > F.col("prefix"), F.col("term"))).alias("others"))
    left = bounded(ranked.where("at <= prefix").select("term", "left_id", "n", "floor", (F.col("held") - F.col("prefix")).alias("rest")))
    # dealt by text once: the pairs' counts need no further shuffle
    found = exploded(b.repartition("right_id"), ["right_id", "right_n"], "right_terms").join(left, "term")
    found = found.groupBy("left_id", "right_id", "right_n", "n", "floor", "rest").agg(F.count("*").alias("counted"))
    needed = F.col("floor") / (1 + F.col("floor")) * (F.col("n") + F.col("right_n"))
    found = found.where(F.col("counted") + F.col("rest") >= needed - 1e-9).drop("right_n", "floor", "rest")
    out = found.join(b, "right_id").join(bounded(others), "left_id")
    shared = F.col("counted") + F.size(F.filter("others", lambda t: F.array_contains("right_terms", t)))
    out = out.select("left_id", "right_id", "n", "right_n", shared.alias("shared"))
    return out.select("left_id", "right_id", (F.col("shared") / (F.col("n") + F.col("right_n") - F.col("shared"))).alias("jaccard"))


def best_by_terms(left: DataFrame, right: DataFrame, k: int = 1, least: float = 0.0) -> DataFrame:
    """left_id, right_id, jaccard, rank: each left text's k best of all right ones, of `least` at least and above zero; exact.

    A pair of a Jaccard index of t shares t of the left's n terms at least, so it shares one of all but the t n - 1 most
    frequent of them. The floor t is `least`, or what the k best reach that share one of the SEEDS rarest terms; the
    candidates share a term of that prefix. Frequent terms, by which every text would meet every other, are left out
    wherever a floor allows it. left is the smaller side: its terms are broadcast up to a bound.
    """
    terms = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), T.match_terms("text").alias(f"{s}_terms")).withColumn(f"{s}_n", F.size(f"{s}_terms"))
    a, b = stash(terms(left, "left"), "left-terms"), stash(terms(right, "right"), "right-terms")
    own = exploded(a, ["left_id", F.col("left_n").alias("n")], "left_terms")
    df = exploded(b, [], "right_terms").join(bounded(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("left_id").orderBy("df", "term")
    ranked = own.join(bounded(stash(df, "term-counts")), "term").withColumn("at", F.row_number().over(rare))
    ranked = stash(ranked.withColumn("held", F.count("*").over(Window.partitionBy("left_id"))), "ranked-terms")
    if least > 0:
        floored = ranked.withColumn("floor", F.lit(float(least)))
    else:
        first = ranked.withColumn("floor", F.lit(0.0)).withColumn("prefix", F.least(F.lit(SEEDS), "held"))
        seeds = best_match(_verified(first, b), k=k)
        floor = seeds.groupBy("left_id").agg(F.when(F.count("*") >= k, F.min("jaccard")).otherwise(0.0).alias("floor"))
        floored = ranked.join(bounded(stash(floor, "floors")), "left_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    floored = floored.withColumn("floor", F.greatest(F.col("floor") - 1e-9, F.lit(0.0)))
    needed = F.greatest(F.ceil(F.col("floor") * F.col("n")), F.lit(1))
    out = _verified(floored.withColumn("prefix", F.greatest(F.col("held") - needed + 1, F.lit(0))), b)
    return best_match(out.where(F.col("jaccard") >= least - 1e-9), k=k)


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio with its defaults; the order of its arguments matters (no built-in computes it)."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype=float)


def similarity(left, right):
    """0.6 of the terms' Jaccard index and 0.4 of the sequence ratio of the comparison forms."""
    return 0.6 * T.jaccard(T.match_terms(left), T.match_terms(right)) + 0.4 * sequence_ratio(T.match_form(left), T.match_form(right))


class Blend:
    """Scores of earlier forms with a block of current ones by `similarity`, in the earlier ones' tasks."""

    def __init__(self, forms: list[str]):
        self.block, self.terms = ratio.Block(forms), [self._terms(f) for f in forms]
        having = defaultdict(list)
        for i, own in enumerate(self.terms):
            for term in own:
                having[term].append(i)
        self.having = {term: np.array(own) for term, own in having.items()}
        self.n = np.array([len(own) for own in self.terms], np.int64)

    @staticmethod
    def _terms(form: str) -> set[str]:
        """As `T.match_terms`, of a form."""
        return set(form.split(" ")).difference(V.MATCH_STOPWORDS, ("",))

    def jaccard(self, old: str) -> np.ndarray:
        own = self._terms(old)
        met = [self.having[t] for t in own if t in self.having]
        shared = np.bincount(np.concatenate(met), minlength=len(self.n)) if met else np.zeros(len(self.n), np.int64)
        return shared / np.maximum(self.n + len(own) - shared, 1)

    def likely(self, old: str) -> np.ndarray:
        """A guess at the scores: nothing but the first candidates depends on it."""
        jaccard, chars = self.jaccard(old), self.block.sizes + len(old)
        return 0.6 * jaccard + np.where(self.block.laid, 0.08, 0.4) * self.block.shared(old) / np.maximum(chars, 1)

    def able(self, old: str, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The current forms with which old could reach the floor, and the Jaccard index with each form."""
        jaccard, chars = self.jaccard(old), self.block.sizes + len(old)

        def reach(most):
            return 0.6 * jaccard + 0.4 * np.where(chars > 0, 2 * most / np.maximum(chars, 1), 1.0) >= floor - SLACK

        # the cheapest bound first
        out = reach(np.minimum(self.block.sizes, len(old)))
        if out.any():
            shared = self.block.shared(old)
            out &= reach(shared)
            if (out & self.block.laid).any():
                out &= ~self.block.laid | reach(self.block.held_in_grams(old))
        return np.flatnonzero(out), jaccard

    def matched(self, first: ratio.First, i: int, jaccard: float, floor: float) -> int:
        """Characters that difflib matches, or -1 if they leave the score below the floor."""
        least = (floor - SLACK - 0.6 * jaccard) * (len(first.text) + self.block.sizes[i]) / 0.8
        return ratio.matched(first, self.block.texts[i], float(least))

    def score(self, old: str, i: int, jaccard: float, matched: int) -> float:
        chars = len(old) + int(self.block.sizes[i])
        return 0.6 * jaccard + 0.4 * (2.0 * matched / chars if chars else 1.0)


#: Scores closer than this may be equal (they are ranked by ten digits).
SLACK = 1e-9
#: Candidates an item and wanted row by which the floors are found.
LIKELY = 4
#: Pairs whose matches a task keeps for further copies of a text.
KEPT = 5_000


def best_blend(current: DataFrame, earlier: DataFrame, k: int = 1) -> DataFrame:
    """left_id, right_id, score, rank: each current text's k best of all earlier ones by `similarity`, exact. Both: id, text.

    A block of current texts is sent to the earlier texts' tasks, where every pair is bounded: by its Jaccard index and by
    the characters that both texts, or grams of both, can have in common (`functions.ratio`). The ratio is worked out only
    for pairs that can reach the k-th best score so far. The first floor is the k-th best score of a few likely candidates
    of all earlier texts. No pair is stored but each task's k best. Texts that are null take no part.
    """
    known = "id is not null and text is not null"  # the form is made once: a filter on it would make it again
    forms = stash(earlier.where(known).select(F.col("id").alias("right_id"), T.match_form("text").alias("_old")), "earlier-forms")
    return in_blocks(current, "id", lambda block: _best_blend(block.where(known), forms, k))


def _best_blend(current: DataFrame, forms: DataFrame, k: int) -> DataFrame:
    asked = current.select("id", T.match_form("text").alias("form")).toArrow()  # a block
    ids, sent = asked.column(0).combine_chunks(), current.sparkSession.sparkContext.broadcast(asked.column(1).to_pylist())
    schema = f"left_id {current.schema['id'].dataType.simpleString()}, right_id {forms.schema['right_id'].dataType.simpleString()}"

    def rows(items, right, score, more=()):
        each = pa.array(np.asarray(items, np.int64))
        return pa.RecordBatch.from_arrays([ids.take(each), right, pa.array(score, pa.float64()), *more], names=["left_id", "right_id", "score", *["_at"] * len(more)])

    def likely(batches):
        """Each task's likeliest texts of each current one."""
        blend, most = Blend(sent.value), LIKELY * k
        for b in batches:
            guesses = [blend.likely(old) for old in b.column(1).to_pylist()]
            if guesses and len(ids):
                # the first rows of equal guesses are as good as others
                guesses = np.array(guesses).T
                top = np.argpartition(-guesses, most - 1, axis=1)[:, :most] if guesses.shape[1] > most else np.tile(np.arange(guesses.shape[1]), (len(ids), 1))
                items = np.repeat(np.arange(len(ids)), top.shape[1])
                yield rows(items, b.column(0).take(pa.array(top.ravel())), np.take_along_axis(guesses, top, 1).ravel(), [pa.array(items)])
        release()

    def seeded(batches):
        """Scores of the likely pairs: _at is the current text's place in the block."""
        blend = Blend(sent.value)
        for b in batches:
            at, olds = b.column(1).to_pylist(), b.column(2).to_pylist()
            scores = []
            for i, old in zip(at, olds):
                jaccard = float(blend.jaccard(old)[i])
                scores.append(blend.score(old, i, jaccard, blend.matched(ratio.First(old), i, jaccard, 0.0)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scores, pa.float64())], names=["_at", "score"])
        release()

    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    first = forms.mapInArrow(likely, f"{schema}, score double, _at long").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LIKELY * k)
    first = stash(first.select("_at", "right_id").distinct(), "likely-pairs")
    # a stated number of tasks: few bytes, much work
    tasks = current.sparkSession.sparkContext.defaultParallelism
    pairs = forms.join(F.broadcast(first), "right_id").select("right_id", "_at", "_old").repartition(tasks, "right_id", "_at")
    seeds = pairs.mapInArrow(seeded, "_at long, score double").groupBy("_at").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    floor = np.zeros(len(ids))
    for r in seeds.where(F.size("s") >= k).select("_at", F.element_at("s", k).alias("least")).collect():  # a block
        floor[r["_at"]] = r["least"]
    floors = current.sparkSession.sparkContext.broadcast(floor)

    def best(batches):
        """Each task's k best texts of each current one, exact."""
        blend, floor = Blend(sent.value), floors.value.copy()
        top, kept, kind = [[] for _ in range(len(ids))], {}, None
        for b in batches:
            kind = b.column(0).type
            for right, old in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                able, jaccard = blend.able(old, floor)
                first = ratio.First(old)
                for i in able.tolist():
                    # what is known of a copy holds: a floor never falls
                    m = kept.get((old, i))
                    if m is None:
                        m = blend.matched(first, i, jaccard[i], floor[i])
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[old, i] = m
                    if m < 0 or (score := blend.score(old, i, float(jaccard[i]), m)) <= 0:
                        continue
                    insort(top[i], (-round(score, 10), right, score))
                    if len(top[i]) > k:
                        top[i].pop()
                    if len(top[i]) == k:
                        floor[i] = max(floor[i], top[i][-1][2])
        if kind is not None:
            out = [(i, right, score) for i, own in enumerate(top) for _, right, score in own]
            yield rows([x[0] for x in out], pa.array([x[1] for x in out], kind), [x[2] for x in out])
        release()

    return best_match(forms.mapInArrow(best, f"{schema}, score double"), "score", k)


def difference_reasons(old, new):
    """Which of numbers and actions differ between two versions."""
    a, b, x, y = T.clinical_numbers(old), T.clinical_numbers(new), T.actions(old), T.actions(new)
    return F.array_compact(F.array(F.when(a != b, "numbers"), F.when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), "actions")))


def classify(matched: DataFrame, score: str = "score", structural: str = "structural", reasons: str = "reasons") -> DataFrame:
    """Adds unmatched, duplicate and differs. A weak score is unmatched even where the structure matches; a row may be both others."""
    s, weak = F.col(score), F.coalesce(F.col(score) < V.MATCH_LEAST, F.lit(True))
    out = matched.withColumn("unmatched", weak).withColumn("duplicate", ~weak & (s >= V.DUPLICATE_LEAST))
    return out.withColumn("differs", ~weak & (F.size(reasons) > 0) & (F.col(structural) | (s >= V.DIFFERENCE_LEAST)))


def structural_match(spark, rows: DataFrame, section: str = "section", ordinal: str = "ordinal") -> DataFrame:
    """Adds matched_id: the id at the row's place in its section; null beyond the section's list."""
    ids = spark.createDataFrame([(s, i + 1, x) for s, xs in V.STRUCTURE.items() for i, x in enumerate(xs)], "_s string, _o int, matched_id string")
    return rows.join(F.broadcast(ids), (F.col(section) == F.col("_s")) & (F.col(ordinal) == F.col("_o")), "left").drop("_s", "_o")


class Links(NamedTuple):
    """Links of rows that share a member, by classes: rows with the same members are one class, and link to the same rows."""

    #: id and class (the members, sorted) of each row, a row an id.
    support: DataFrame
    current: DataFrame
    #: support_class and current_class that share a member, once, and n, first and last (smallest and largest id) of both.
    classes: DataFrame


def links(support: DataFrame, current: DataFrame, on: str = "sites") -> Links:
    """Links between rows (id, and `on`, an array) that share a member. Memberships and class pairs, not pairs of rows.

    An id that stands in several rows has all their members; null members and rows without any link to nothing. There are
    as many classes as different sets of members, and pairs of classes come from an equi-join on members.
    """

    def member(rows, name):
        each = rows.select("id", F.explode(on).alias("k")).where("k is not null and id is not null")
        return stash(each.groupBy("id").agg(F.sort_array(F.collect_set("k")).alias("class")), f"{name}-classes")

    a, b = member(support, "support"), member(current, "current")

    def classes(rows, name):
        own = rows.groupBy("class").agg(F.count("*").alias(f"{name}_n"), F.min("id").alias(f"{name}_first"), F.max("id").alias(f"{name}_last"))
        return own.withColumnRenamed("class", f"{name}_class").withColumn("k", F.explode(f"{name}_class"))

    x, y = classes(a, "support"), classes(b, "current")
    # a pair of classes stands under each member that both have; its smallest names it, so no distinct is needed
    pairs = x.join(bounded(y), "k").where(F.col("k") == F.array_min(F.array_intersect("support_class", "current_class"))).drop("k")
    return Links(a, b, stash(pairs, "class-links"))


#: Ids of all classes' lists up to which these are broadcast.
BROADCAST_IDS = 5_000_000


def linked(found: Links, side: str = "support", ids: bool = False) -> DataFrame:
    """{side}_id with n, first and last of the rows that it is linked to; ids without a link are left out.

    ids: all their ids too, sorted. A class's list is made once and joined to its rows; a cell holds the whole list.
    """
    other = "current" if side == "support" else "support"
    own = found.classes.groupBy(F.col(f"{side}_class").alias("class")).agg(F.sum(f"{other}_n").alias("n"), F.min(f"{other}_first").alias("first"), F.max(f"{other}_last").alias("last"))
    rows, names = getattr(found, side), [F.col("id").alias(f"{side}_id"), "n", "first", "last"]
    if not ids:
        return rows.join(bounded(own), "class").select(*names)
    pairs = found.classes.select(F.col(f"{side}_class").alias("class"), F.col(f"{other}_class").alias("_other"))
    members = getattr(found, other).select(F.col("id").alias("_id"), F.col("class").alias("_other"))
    lists = members.join(bounded(pairs), "_other").groupBy("class").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    own = stash(own.join(lists, "class"), "linked-ids")
    held = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rows.join(F.broadcast(own) if held <= BROADCAST_IDS else own, "class").select(*names, "ids")


def expanded(found: Links) -> DataFrame:
    """support_id, current_id of every link, each once: as many rows as there are links, so for a few ids at a time."""
    name = lambda rows, side: rows.select(F.col("id").alias(f"{side}_id"), F.col("class").alias(f"{side}_class"))
    pairs = found.classes.select("support_class", "current_class")
    out = name(found.support, "support").join(bounded(pairs), "support_class").join(name(found.current, "current"), "current_class")
    return out.select("support_id", "current_id")
