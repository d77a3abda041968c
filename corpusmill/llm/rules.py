"""Quality rules with an isolation forest on rule statistics.

Each document's statistics come from its whole text in one pass; two base rules reject at once. The rest is judged by
an isolation forest: trees of random splits over the statistics, each grown on a subsample (SUBSAMPLE rows, as the method
defines it) drawn from all documents, in which
anomalies have short paths. The threshold on the anomaly score is calibrated on all labelled rows: it has the largest share of
poor rows rejected less `cost` times the share of good rows rejected. Of a few sets of statistics, up to all of the rules',
the one whose forest gains most there is taken.

Defined cases: a null text has no words (all counts 0, fails the base rules); texts of any length are taken whole;
labels other than 0 and 1 don't count;
without labelled rows of both kinds the forest rejects nothing; repeated rows are each judged alike; an empty table
gives an empty result; other columns are left out (the query) or pass through (`keep`).

Scale: one scan that yields a narrow stored table of numbers; labelled rows are scored and their scores summed in order of
range by Spark, so of them the driver gets a row a range; the trees' subsamples are of a fixed size; the forest (TREES x 2 x SUBSAMPLE nodes) is the only thing sent to all tasks. No text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_scratch, keep_rows, share_of, stash, table

SPACE = b" \t\n\r\x0b\x0c"
#: Continuation bytes of UTF-8: what is no code point of its own.
INNER = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Statistics of the rules: shares of the text's code points that separate columns, cry out or are other symbols; mean code
#: points of a word; distinct words by the square root of all, which repetition lowers; shares of the lines that repeat an
#: earlier one and of the words in repeated windows.
STATS = ["columns", "cries", "symbols", "word_length", "kinds", "dup_lines", "repeats"]
#: How many of them, from the first, a forest sees: of these, what gains most on the labelled rows is taken.
SETS = (3, 5, 7)
WINDOW = 8
TREES, SUBSAMPLE = 200, 256
#: How many times the share of poor labelled rows the share of good ones counts, when the threshold is chosen.
COST = 10.0


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for i in range(window):
        roll = (roll + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        roll ^= roll >> np.uint64(29)
    ordered = np.sort(roll)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(roll, np.unique(twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(b: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the forest's statistics."""
    words = b.split()
    n = len(words)
    chars = len(b.translate(None, SPACE + INNER))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    whole = max(len(b.translate(None, INNER)), 1)
    columns, cries = b.count(b"|"), b.count(b"!")
    stats = columns / whole, cries / whole, (symbols - columns) / whole, chars / max(n, 1), len(set(words)) / max(n, 1) ** 0.5
    stats += dup / max(len(lines), 1), repeats / max(n, 1)
    return n, chars, symbols, dup, repeats, *stats


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts and the statistics of every document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [key, *counts, *STATS]

    def run(batches):
        for b in batches:
            cols = list(zip(*[measure(x or b"") for x in b.column(1).to_pylist()])) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * len(counts) + [pa.float64()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join([f"{c} long" for c in counts] + [f"{c} double" for c in STATS])
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


class Forest:
    """An isolation forest: each tree splits a random subsample at random until its rows are alone or the tree is deep."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7, first: int | None = None):
        """first: how many columns it sees, from the first on (all)."""
        rng = np.random.default_rng(seed)
        x = x[:, :first]
        self.size = min(subsample, len(x))
        self.depth = max(int(np.ceil(np.log2(max(self.size, 2)))), 1)
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def mean_path(n) -> np.ndarray:
        """Mean path length of an unsuccessful search in a binary tree of n."""
        n = np.asarray(n, float)
        m = np.maximum(n - 1, 1)
        return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, x: np.ndarray, rng):
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows, depth):
            me = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, me), (right, me), (length, 0.0)):
                a.append(v)
            lo, hi = rows.min(0), rows.max(0)
            able = np.flatnonzero(hi > lo)
            if depth >= self.depth or len(rows) < 2 or not len(able):
                length[me] = depth + float(self.mean_path(len(rows)))
                return me
            feature[me] = int(rng.choice(able))
            cut[me] = float(rng.uniform(lo[feature[me]], hi[feature[me]]))
            below = rows[:, feature[me]] < cut[me]
            left[me], right[me] = node(rows[below], depth + 1), node(rows[~below], depth + 1)
            return me

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the minus mean path over its expectation."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]))
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self.mean_path(self.size)), 1e-9))


def _some(df: DataFrame, key: str, most: int) -> np.ndarray:
    """The statistics of about `most` rows: each row as likely, also of those that share an id, and the same in any layout.

    Of rows equal in id and statistics so many are taken as their number times the share says, and one more by a draw
    seeded by both. So what the driver gets exceeds `most` by a few hundred at the utmost.
    """
    n, each = df.count(), F.lit(1)
    if n > most:
        per, share = df.groupBy(key, *STATS).agg(F.count("*").alias("_n")), most / n
        whole = F.floor(F.col("_n") * share)
        extra = share_of(F.xxhash64(F.lit(0), key, *STATS)) < F.col("_n") * share - whole
        df, each = per.withColumn("_n", whole + extra.cast("long")).where("_n > 0"), F.col("_n")
    got = df.select(*STATS, each.cast("double").alias("_n")).toPandas().to_numpy(float)
    got = np.repeat(got[:, :-1], got[:, -1].astype(np.int64), axis=0)
    return got[np.lexsort(got.T)] if len(got) else got.reshape(0, len(STATS))


def _scored(known: DataFrame, forests: list[Forest]) -> DataFrame:
    """_label and each forest's score of every labelled row."""
    shared = known.sparkSession.sparkContext.broadcast(forests)
    names = [f"s{i}" for i in range(len(forests))]

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(1 + i).to_numpy() for i in range(len(STATS))]) if len(b) else np.empty((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f.score(x)) for f in shared.value)], names=["_label", *names])

    return known.select(F.col("_label").cast("int").alias("_label"), *STATS).mapInArrow(run, "_label int, " + ", ".join(f"{n} double" for n in names))


def best_cut(scored: DataFrame, score: str, good: int, poor: int, cost: float) -> tuple[float, float]:
    """The gain and the score of the best threshold, over all rows (score, _label); the largest of equal ones, 2 if none gains.

    Equal scores are one row; the rows are dealt by ranges of the score, and a table of the ranges' sums carries the counts on.
    """
    count = lambda v: F.count_if(F.col("_label") == v)
    each = scored.groupBy(F.col(score).alias("s")).agg(count(1).alias("good"), count(0).alias("poor")).repartitionByRange("s")
    each = stash(each.withColumn("part", F.spark_partition_id()), "rules-scores")
    sums = each.groupBy("part").agg(F.sum("good").alias("g"), F.sum("poor").alias("p")).orderBy("part").collect()  # a row a range
    before, g, p = [], 0, 0
    for r in sums:
        before.append((r.part, g, p))
        g, p = g + r.g, p + r.p
    before = scored.sparkSession.createDataFrame(before, "part int, g long, p long")
    so_far = Window.partitionBy("part").orderBy("s")
    below = lambda own, passed: F.col(passed) + F.sum(own).over(so_far) - F.col(own)
    gain = (1 - below("poor", "p") / poor) - cost * (1 - below("good", "g") / good)
    top = each.join(F.broadcast(before), "part").select(gain.alias("gain"), "s").agg(F.max(F.struct("gain", "s")).alias("top")).first().top
    return (top.gain, top.s) if top is not None and top.gain > 0 else (0.0, 2.0)


@in_scratch
def fit(stats: DataFrame, labels: DataFrame | None, key: str = "doc_id", label: str = "quality", cost: float = COST):
    """The forest and the anomaly score from which it rejects."""
    passed = stats.where(~base_failed())
    x = _some(passed, key, TREES * SUBSAMPLE)  # what the trees together draw
    if len(x) < 2:
        return None, 2.0
    if labels is None:
        return Forest(x), 2.0
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    known = stash(passed.join(known, F.col(key) == F.col("_key")).select(key, *STATS, "_label"), "rules-labelled")
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    good, poor = counts.get(1, 0), counts.get(0, 0)
    if not good or not poor:
        return Forest(x), 2.0
    forests = [Forest(x, first=first) for first in SETS]
    scored, best = stash(_scored(known, forests), "rules-scored"), None
    for i, forest in enumerate(forests):
        gain, cut = best_cut(scored, f"s{i}", good, poor, cost)
        if best is None or gain > best[0] + 1e-9:
            best = gain, forest, float(cut)
    return best[1:]


def judge(stats: DataFrame, forest: Forest | None, threshold: float, key: str = "doc_id") -> DataFrame:
    """stats with base_failed, anomaly and kept."""
    out = stats.withColumn("base_failed", base_failed())
    if forest is None:
        return out.withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    names = [*out.columns, "anomaly"]
    first = names.index(STATS[0])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(first + i).to_numpy() for i in range(len(STATS))]) if len(b) else np.empty((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], names=names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = out.mapInArrow(run, StructType([*out.schema, StructField("anomaly", DoubleType())]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def verdicts(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    stats = stash(statistics(docs, key, text), "rules-stats")
    return judge(stats, *fit(stats, labels, key), key)


def keep(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules keep. Every row is judged by its own text, in the scan that returns it."""
    forest, threshold = fit(stash(statistics(docs, key, text), "rules-stats"), labels, key)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(texts):
        rows = [measure(x) for x in texts]
        good = np.array([not (r[0] < 20 or 100 * r[4] > 30 * r[0]) for r in rows], bool)
        if shared.value is not None and len(rows):
            good &= shared.value.score(np.array([r[5:] for r in rows], float)) < threshold
        return good

    return keep_rows(docs, text, [], judge)


def op9_rules(spark, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
