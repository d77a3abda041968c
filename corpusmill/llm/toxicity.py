"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: the ordinary one holds the words that ordinary documents use
most, the toxic one the same and before it the segments that mark toxic documents (runs of byte k-mers found in toxic
documents far more often than in ordinary ones, by document frequency and G2). Each window of WORDS words of a text (a
window of over BYTES bytes, as in text without spaces, in overlapping parts) is compressed with either; a window that the toxic dictionary makes shorter holds what marks toxic text. A text's largest
and mean gains and its numbers of windows by gain are weighed by a logistic calibration, fitted on labelled rows that
the dictionaries were not made from. Of a few settings for the k-mers the one with the least loss there is taken.

Learning uses PER_CLASS labelled documents of each label at most, of any length, chosen by their id's hash among those whose
fold isn't held out; the calibration weighs the classes back to their shares. The driver gets their distinct words
(DISTINCT of a document at most) and their features, which the tasks make of whole texts.

Defined cases: null, empty and wordless texts have no windows and get the score of no gain; without labelled rows of both
kinds every score is 0; repeated rows are each scored; texts are windowed whole, of any length; an empty table gives an
empty result; other columns are left out.

Scale: the sample is bounded by the parameters, the dictionaries by SIZE; each document is scored, and for `drop_toxic`
dropped, in one scan: nothing is shuffled but ids for the sample.
"""

from __future__ import annotations

import functools
import heapq
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_scratch, keep_rows, labelled_sample, logistic, release, sigmoid, table

PER_CLASS, SIZE, WORDS = 1_500, 8_192, 12
#: Distinct words of a document that the dictionaries are made from, at most.
DISTINCT = 2_000
#: Bytes of a window at most, and bytes that the parts of a longer one share: beyond the compressors' window the
#: dictionaries would be out of reach, and a gain in a long window would be lost among its other bytes.
BYTES, SHARED = 256, 64
#: Bytes of the ordinary dictionary put before each window: a window that saves too little is stored as it is, and these
#: save enough in either dictionary for every further byte to show.
LEAD = 40
#: Settings tried: lengths of k-mers (none: whole words), least G2, least ratio of document frequencies.
SETTINGS = [((4,), 18.0, 8.0), ((4, 5), 18.0, 8.0), ((4, 6, 8), 25.0, 20.0)]
GAINS = (1, 2, 3, 4, 5, 6, 8, 10)


def windows(words: list[bytes]):
    """Windows of WORDS words; one of over BYTES bytes in parts that overlap, cut between code points."""
    for i in range(0, len(words), WORDS):
        w = b" ".join(words[i : i + WORDS])
        start, end = 0, BYTES
        while end < len(w):
            end = _code_point(w, end)
            yield w[start:end]
            start = _code_point(w, end - SHARED)
            end = start + BYTES
        yield w[start:]


def _code_point(w: bytes, at: int) -> int:
    """at, or where the code point that goes on there begins (at most three bytes before)."""
    for back in range(4):
        if w[at - back] & 0xC0 != 0x80:
            return at - back
    return at


def kmers(word: bytes, lengths) -> set[bytes]:
    """The k-mers of a word of these lengths; the word itself for no lengths."""
    return {word[i : i + n] for n in lengths for i in range(len(word) - n + 1)} if lengths else {word}


def g2(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of a of na against b of nb."""
    n, both, out = na + nb, a + b, 0.0
    for seen, expected in ((a, both * na / n), (b, both * nb / n), (na - a, (n - both) * na / n), (nb - b, (n - both) * nb / n)):
        if seen > 0:
            out += 2 * seen * math.log(seen / expected)
    return out


def counts_by_class(rows: list[np.ndarray], toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and other rows each of n numbers stands; a row has a number once."""
    out = np.zeros((2, n), np.int64)
    for row, bad in zip(rows, toxic):
        out[0 if bad else 1][row] += 1
    return out[0], out[1]


def dictionaries(words: list[bytes], rows: list[np.ndarray], toxic: np.ndarray, lengths, least: float, ratio: float) -> tuple[bytes, bytes]:
    """What the toxic and the ordinary dictionary hold, made from documents' distinct words (rows: numbers of words)."""
    ids, flat, starts = {}, array("i"), array("q", [0])
    for w in words:
        flat.extend(ids.setdefault(k, len(ids)) for k in kmers(b" " + w + b" ", lengths))
        starts.append(len(flat))
    flat, starts = np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32), np.frombuffer(starts, np.int64)
    parts = [np.unique(np.concatenate([np.empty(0, np.int32), *(flat[starts[i] : starts[i + 1]] for i in row)])) for row in rows]
    seen, heard = counts_by_class(parts, toxic, len(ids))
    na, nb = int(toxic.sum()), int((~toxic).sum())
    able = np.flatnonzero((seen >= 4) & (seen / na > ratio * (heard + 0.5) / nb))
    names = list(ids)
    marks = {names[i] for i in able.tolist() if g2(int(seen[i]), int(heard[i]), na, nb) > least}
    del ids, names, parts
    in_toxic, in_other = counts_by_class(rows, toxic, len(words))
    segments = Counter()
    for at in np.flatnonzero(in_toxic).tolist():
        w = b" " + words[at] + b" "
        covered = bytearray(len(w))
        for k in lengths or (len(w),):
            for i in range(len(w) - k + 1):
                if w[i : i + k] in marks:
                    covered[i : i + k] = b"\1" * k
        start = None
        for i, c in enumerate([*covered, 0]):
            if c and start is None:
                start = i
            elif not c and start is not None:
                segments[w[start:i]] += int(in_toxic[at])
                start = None
    by = lambda c: [x for x, _ in sorted(c, key=lambda e: (-e[1], e[0]))]
    usual = by((words[i], int(in_other[i])) for i in np.flatnonzero(in_other).tolist())
    common = b" ".join(reversed(usual[:2000]))[-SIZE:] or b"\0" * 8
    return b"\0".join(reversed(by(segments.items())[:800]))[-SIZE:] + b"\0" + common, common


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts, self.weights, self.scale = (toxic, ordinary), None, None

    @functools.cached_property
    def compressors(self):
        settings = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.parts]
        return [zstandard.ZstdCompressor(dict_data=d, compression_params=settings) for d in held]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def features(self, text: bytes) -> list[float]:
        words = text.lower().split()
        toxic, ordinary = (c.compress for c in self.compressors)
        lead = self.parts[1][-LEAD:] + b" "
        gain = np.sort(np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in (lead + x for x in windows(words))), np.int64))
        n = len(gain)
        if not n:
            return [0.0] * (4 + len(GAINS))
        over = n - np.searchsorted(gain, GAINS)
        return [float(gain[-1]), float(gain[-3:].mean()), float(gain.mean()), math.log(n), *np.log1p(over).tolist()]

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        mean, dev = x.mean(0), x.std(0) + 1e-6
        self.scale = mean, dev
        self.weights = logistic((x - mean) / dev, y, weight, 0.3)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.c_[(x - self.scale[0]) / self.scale[1], np.ones(len(x))] @ self.weights)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.probability(np.array([self.features(t) for t in texts]).reshape(len(texts), 4 + len(GAINS)))


def distinct_words(text: bytes, most: int = DISTINCT) -> list[bytes]:
    """The distinct words of a text (parts of a word of over BYTES bytes), at most so many, those of least hash."""
    words = {part for w in set(text.split()) for part in windows([w])}
    return sorted(words) if len(words) <= most else sorted(heapq.nsmallest(most, words, key=lambda w: (hash_of(w), w)))


def _collected(rows: DataFrame, key: str, text: str, schema: str, make) -> pa.Table:
    """An Arrow table of key, label, side (the text's hash) and what make(text) gives, ordered; made by the tasks."""
    def run(batches):
        for b in batches:
            texts = [(x or b"").lower() for x in b.column(2).to_pylist()]
            side = pa.array([hash_of(t) >> 1 for t in texts], pa.int64())
            own = pa.array([make(t) for t in texts], pa.list_(pa.binary() if "binary" in schema else pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), side, own], names=["key", "label", "side", "made"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, "__label", F.col(text).cast("binary")).mapInArrow(run, f"key {kind}, label int, side long, made {schema}")
    return out.toArrow().sort_by([("key", "ascending"), ("side", "ascending")]).combine_chunks()


@in_scratch
def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Scorer | None:
    """A scorer of the labelled documents in docs; both must hold only what may be learned from."""
    sample, counts = labelled_sample(docs.select(key, text), labels, label, per_class, key, text)
    got = _collected(sample, key, text, "array<binary>", distinct_words)
    y = got["label"].to_numpy().astype(int)
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return None
    share = np.array([counts.get(v, 0) / max((y == v).sum(), 1) for v in (0, 1)])
    weight = share[y] / share[y].mean()
    # three of five documents make the dictionaries, the others the calibration; copies of a text stay on one side
    side = got["side"].to_numpy() % 5 < 3
    if min((y[side] == 1).sum(), (y[~side] == 1).sum(), (y[side] == 0).sum(), (y[~side] == 0).sum()) < 1:
        side = np.arange(len(y)) % 2 == 0
    made = got.filter(pa.array(side))["made"].combine_chunks()
    numbered = made.flatten().dictionary_encode()
    words, rows = numbered.dictionary.to_pylist(), np.split(numbered.indices.to_numpy(), np.cumsum(made.value_lengths().to_numpy())[:-1])
    del made, numbered
    scorers = [Scorer(*dictionaries(words, rows, y[side] == 1, *setting)) for setting in SETTINGS]
    shared, n = docs.sparkSession.sparkContext.broadcast(scorers), 4 + len(GAINS)
    rest = np.flatnonzero(~side)
    # the tasks make the features, of whole texts
    each = _collected(sample, key, text, "array<double>", lambda t: [x for s in shared.value for x in s.features(t)])
    every = np.array(each["made"].to_pylist()).reshape(len(y), len(scorers), n)[rest]
    best, loss = None, math.inf
    own, w = y[rest], weight[rest]
    for i, scorer in enumerate(scorers):
        x = every[:, i]
        held = np.zeros(len(rest))
        for f in range(4):
            at = np.arange(len(rest)) % 4 == f
            if at.all() or not at.any():
                continue
            held[at] = scorer.calibrate(x[~at], own[~at], w[~at]).probability(x[at])
        p = np.clip(np.where(own == 1, held, 1 - held), 1e-6, 1)
        if (now := float(-(w * np.log(p)).sum())) < loss:
            best, loss = scorer.calibrate(x, own, w), now
    return best


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 0)


def score(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted of every document; key may be a list of columns."""
    keys = [key] if isinstance(key, str) else list(key)
    if scorer is None:
        return docs.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        for b in batches:
            out = shared.value.score([x or b"" for x in b.column(len(keys)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out)], names=[*keys, "score"])
        release()

    out = docs.select(*keys, F.col(text).cast("binary")).mapInArrow(run, StructType([*(docs.schema[k] for k in keys), StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those predicted toxic. Every row is judged by its own text, in the scan that returns it."""
    may = fold_of(key) != 0
    scorer = learn(docs.where(may), labels.where(may), key, text)
    if scorer is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return keep_rows(docs, text, [], lambda texts: shared.value.score(texts) < 0.5)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scorer = learn(docs.where(fold_of() != 0), labels.where(fold_of() != 0))
    return score(docs, scorer).withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
