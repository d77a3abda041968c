"""A quality classifier by co-training.

Two views of a document are learned apart: its text (byte trigrams, hashed, with how often words and trigrams repeat) and
its page metadata (language, source, stated length, and the shape of its lines: how many, how long, how full). Each view
starts on the labelled sample; in every round each names the unlabelled documents that it is surest of, and they join the
other view's training rows with that label. At the end each view is calibrated on labelled rows that it was not trained
on, and a logistic combination of the two calibrated views scores all documents: the probability of label 1.

Learning uses PER_CLASS labelled documents of each label and POOL unlabelled ones at most, of any length, chosen by their
id's hash among those whose fold isn't held out; the driver gets their views, a fixed size a document. The labels, ids and
folds are never features.

Defined cases: null, empty and wordless texts have the features of an empty text; null languages and sources are values of
their own, as are those that the sample doesn't have; without labelled rows of both kinds every score is 1 and nothing is
rejected; repeated rows are each scored; an empty table gives an empty result; other columns are left out.

Scale: the samples are bounded by parameters, the models by DIMS; each document is scored, and for `keep_good` dropped, in
one scan: nothing is shuffled but ids for the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .common import fold_of, in_scratch, keep_rows, labelled_sample, least_by_hash, logistic, one_each, release, share_by_hash, sigmoid, stash, table

PER_CLASS, POOL, ROUNDS, SURE = 1_500, 2_000, 3, 100
#: Sizes of the text view and of the hashed languages and sources.
DIMS, KINDS = 1 << 10, 32
#: Bytes of a text whose trigrams are counted at once.
STEP = 1 << 20
META = ("lang", "source", "n_chars")


def text_view(b: bytes) -> np.ndarray:
    """Square roots of the hashed trigrams' shares, and three measures of repetition."""
    out = np.zeros(DIMS + 3, np.float32)
    counts, words = np.zeros(DIMS), b.split()
    for at in range(0, max(len(b) - 2, 0), STEP):
        x = np.frombuffer(b[at : at + STEP + 2], np.uint8).astype(np.uint32)
        h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
        counts += np.bincount(h >> np.uint32(32 - 10), minlength=DIMS)
    if words:
        out[:DIMS] = np.sqrt(counts / max(counts.sum(), 1)) * 4
        kinds = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[DIMS:] = kinds / math.sqrt(len(words)) / 10, kinds / len(words), 4 * same
    return out


def meta_view(b: bytes, lang, source, n_chars) -> np.ndarray:
    """Hashed language and source, and the shape of the lines."""
    out = np.zeros(2 * KINDS + 6, np.float32)
    for i, v in enumerate((lang, source)):
        out[i * KINDS + (0 if v is None else 1 + xxhash.xxh32_intdigest(str(v)) % (KINDS - 1))] = 1
    lines = b.count(b"\n") + 1
    blank = b.count(b"\n\n")
    spaces = b.count(b" ")
    stated = -1 if n_chars is None else n_chars
    out[2 * KINDS :] = (
        math.log1p(max(stated, 0)) / 5, float(stated < 0), math.log1p(lines) / 3,
        math.log1p(len(b) / lines) / 5, blank / lines, (len(b) - spaces) / max(spaces + lines, 1) / 10,
    )
    return out


class Linear:
    """L2-regularised logistic regression by gradient steps with momentum; few rows, many columns."""

    def __init__(self, x, y, weight, ridge=1e-4, rounds=300):
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-3
        z = ((x - self.mean) / self.dev).astype(np.float32)
        w, b, m, c = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0
        weight = (weight / weight.sum()).astype(np.float32)
        rate = 4.0 / max(float((weight[:, None] * z * z).sum()) / 4, 1.0)
        for _ in range(rounds):
            g = weight * (sigmoid(z @ w + b) - y).astype(np.float32)
            m = 0.9 * m + g @ z + ridge * w
            c = 0.9 * c + float(g.sum())
            w, b = w - rate * m, b - rate * c
        self.w, self.b = w / self.dev.astype(np.float32), b - float((self.mean / self.dev) @ w)

    def raw(self, x) -> np.ndarray:
        return x @ self.w + self.b


class Model:
    def __init__(self, text: Linear, meta: Linear, scales, joint):
        self.views, self.scales, self.joint = (text, meta), scales, joint

    def score(self, texts, metas):
        """score, text_score, meta_score."""
        each = [np.clip(np.c_[v.raw(x), np.ones(len(x))] @ s, -12, 12) for v, x, s in zip(self.views, (texts, metas), self.scales)]
        return sigmoid(np.c_[each[0], each[1], np.ones(len(each[0]))] @ self.joint), sigmoid(each[0]), sigmoid(each[1])


def views(texts: list[bytes], meta: list[tuple]):
    t = np.array([text_view(b) for b in texts], np.float32).reshape(len(texts), DIMS + 3)
    return t, np.array([meta_view(b, *m) for b, m in zip(texts, meta)], np.float32).reshape(len(texts), 2 * KINDS + 6)


def co_train(x: tuple, y: np.ndarray, pool: tuple, weight: np.ndarray, rounds: int = ROUNDS, sure: int = SURE):
    """The two views' classifiers after exchanging their surest labels of the pool."""
    own = [[np.empty(0, int), np.empty(0, int)] for _ in x]  # pool rows and labels that each view has been given
    open_ = [np.ones(len(pool[0]), bool) for _ in x]
    models = [Linear(v, y, weight) for v in x]
    for _ in range(rounds):
        for i, other in ((0, 1), (1, 0)):
            p = sigmoid(models[i].raw(pool[i])) if len(pool[i]) else np.empty(0)
            for label, order in ((1, np.argsort(-p)), (0, np.argsort(p))):
                able = order[open_[other][order] & ((p[order] > 0.95) if label else (p[order] < 0.05))][:sure]
                open_[other][able] = False
                own[other][0] = np.r_[own[other][0], able]
                own[other][1] = np.r_[own[other][1], np.full(len(able), label)]
        models = [
            Linear(np.vstack([v, q[rows]]), np.r_[y, labels], np.r_[weight, np.full(len(rows), weight.mean() / 4)])
            for v, q, (rows, labels) in zip(x, pool, own)
        ]
    return models


def viewed(rows: DataFrame, keys: list[str], text: str = "text"):
    """A pandas frame of keys, __side (the text's hash) and both views of each row, ordered; made by the tasks.

    A row has a fixed size, whatever its text's; call it on a bounded number of rows.
    """
    k, names = len(keys), [*keys, "__side", "__text", "__meta"]

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(k).to_pylist()]
            t, m = views(texts, list(zip(*(b.column(k + 1 + i).to_pylist() for i in range(len(META))))))
            side = pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], side, *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (t, m))], names=names)

    made = [StructField("__side", LongType()), StructField("__text", BinaryType()), StructField("__meta", BinaryType())]
    out = rows.select(*keys, F.col(text).cast("binary").alias("__bytes"), *META).mapInArrow(run, StructType([*(rows.schema[c] for c in keys), *made]))
    got = out.toPandas().sort_values([keys[0], "__side"], kind="stable").reset_index(drop=True)
    flat = lambda c, n: np.frombuffer(b"".join(map(bytes, got[c])), np.float32).reshape(len(got), n)
    return got, (flat("__text", DIMS + 3), flat("__meta", 2 * KINDS + 6))


@in_scratch
def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, pool: int = POOL):
    """A model of the labelled documents; docs and labels must hold only what may be learned from."""
    docs = docs.select(key, text, *META)
    sample, counts = labelled_sample(docs, labels, label, per_class, key, text)
    got, x = viewed(sample, [key, "__label"], text)
    y = got["__label"].to_numpy(int)
    if min((y == 1).sum(), (y == 0).sum()) < 4:
        return None
    able = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    near = share_by_hash(key, 4 * pool / max(able.count(), 1), 1)
    spare = least_by_hash(able.where(near).select(F.col(key).alias("__key")).distinct(), "__key", pool, 1)
    spare = able.join(F.broadcast(stash(spare, "quality-pool")), F.col(key) == F.col("__key")).drop("__key")  # pool rows
    others, u = viewed(one_each(spare, key, text), [key], text)
    new = ~others[key].isin(got[key]).to_numpy(bool)
    u = tuple(v[new] for v in u)
    share = np.array([counts.get(v, 0) / max((y == v).sum(), 1) for v in (0, 1)])
    weight = share[y] / share[y].mean()
    # a third of the labelled rows calibrates; copies of a text stay on one side
    held = got["__side"].to_numpy() % 3 == 0
    if min((y[held] == 1).sum(), (y[held] == 0).sum(), (y[~held] == 1).sum(), (y[~held] == 0).sum()) < 2:
        held = np.arange(len(y)) % 3 == 0
    models = co_train(tuple(v[~held] for v in x), y[~held], u, weight[~held])
    raw = [m.raw(v[held]) for m, v in zip(models, x)]
    scales = [logistic(r[:, None], y[held], weight[held], 1e-3) for r in raw]
    each = [np.clip(np.c_[r, np.ones(len(r))] @ s, -12, 12) for r, s in zip(raw, scales)]
    return Model(*models, scales, logistic(np.column_stack(each), y[held], weight[held], 0.1))


def score(docs: DataFrame, model: Model | None, keys: list[str], text: str = "text") -> DataFrame:
    """keys, score, text_score, meta_score, predicted of every document."""
    if model is None:
        return docs.select(*keys, *(F.lit(1.0).alias(c) for c in ("score", "text_score", "meta_score")), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keys, "score", "text_score", "meta_score"]
    k = len(keys)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                meta = list(zip(*(b.column(k + 1 + i).to_pylist() for i in range(len(META)))))
                out = shared.value.score(*views([x or b"" for x in b.column(k).to_pylist()], meta))
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(np.asarray(o, float)) for o in out)], names=names)
        release()

    schema = StructType([*(docs.schema[c] for c in keys), *(StructField(c, DoubleType()) for c in names[k:])])
    out = docs.select(*keys, F.col(text).cast("binary").alias("_bytes"), *(F.col(m).alias(f"_{m}") for m in META)).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those predicted poor. Every row is judged by its own text and metadata, in the scan that returns it."""
    may = fold_of(key) != 0
    model = learn(docs.where(may), labels.where(may), key, text)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, list(META), lambda texts, *meta: shared.value.score(*views(texts, list(zip(*meta))))[0] >= 0.5)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", *META), table(spark, sf_dir, "labels")
    model = learn(docs.where(fold_of() != 0), labels.where(fold_of() != 0))
    return score(docs, model, ["doc_id"]).withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
