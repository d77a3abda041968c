"""Language identification by prediction by partial matching.

Per language, a context tree of bytes up to three deep holds how often each byte followed each context in the training
sample. A byte costs -log2(n / (t + d)) bits where it was seen n times in a context seen t times with d different bytes;
where it wasn't, the escape -log2(d / (t + d)) is paid and the next shorter context tried, down to a uniform code (a
context never seen costs nothing to leave). The statistics are frozen, so these code lengths are exact sums of table
entries; a text's language is the one with the shortest code, and the score its share of 2^-bits over all languages.

Learning: about PER_LANGUAGE documents of every language, fewer where there are so many languages that TOTAL in all would
be passed, but LEAST each; chosen by their id's hash among those whose fold isn't held out (all documents of a language
that has no more than LEAST). Chosen documents are read whole, of any length. Their counts are made and summed by the tasks;
the driver gets those of grams that some language has often enough for the trees to keep to CELLS (all of them, but where
there are very many languages).

Defined cases: null texts and those without a letter are `und` with score 0, and so is every text where no language was
learned; documents without an id or language are never learned from, and without an id never held out; ties go to the
first language by code point; repeated rows are each scored; an empty table gives an empty result; other columns are left
out. ASCII letters are taken in lower case; a text is coded as if three zero bytes stood before it.

Scale: one narrow count of languages, one filtered scan, one scan of whole texts; only n-gram counts of the bounded
sample are shuffled, and only the trees (bounded by the sample, times the languages) go to all tasks.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold_of, in_scratch, release, stash, table

#: Documents of each language, and documents in all, that are learned from at most (about).
PER_LANGUAGE, TOTAL = 600, 12_000
#: Documents of a language that are learned from however many languages there are.
LEAST = 24
#: Known byte pairs up to which four bytes are looked up by a square table of pairs.
PAIRS = 4096
#: Costs (positions times languages) that a task holds at once.
HELD = 1 << 21
#: Cells (four-byte grams times languages) that the trees have at most, 20 MB of code lengths an order; grams seen seldom go first.
CELLS = 5 << 20
#: Bytes of texts whose grams are counted at once (about).
COUNTED = 1 << 22


def grams(buffer: np.ndarray) -> np.ndarray:
    """The four bytes that end at each position, from the fourth on."""
    b = buffer.astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _runs(texts):
    """Lists of about COUNTED bytes of texts, each with the three bytes that stand before it; longer texts in parts."""
    held, size = [], 0
    for t in texts:
        data = np.frombuffer(b"\0\0\0" + t.lower(), np.uint8)
        for lo in range(0, len(data) - 3, COUNTED):
            held.append(data[lo : lo + COUNTED + 3])
            size += len(held[-1])
            if size >= COUNTED:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram, n over the texts."""

    def run(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for one in sorted(set(langs)):
                for some in _runs(t for t, k in zip(texts, langs) if k == one and t):
                    g, n = np.unique(np.concatenate([grams(x) for x in some]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        release()

    part = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    return part.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all languages as tables of code lengths."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        k = len(langs)
        # order 0: a single context; then one, two and three bytes
        self.codes, self.costs, self.contexts, self.escapes = {}, {}, {}, {}
        for order in range(4):
            code = gram & ((1 << 8 * (order + 1)) - 1)
            codes, at = np.unique(code, return_inverse=True)
            counts = np.zeros((len(codes), k))
            np.add.at(counts, (at, lang), n)
            contexts, own = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, own, counts)
            np.add.at(kinds, own, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(counts / (total + kinds)[own], dtype=np.float32)
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.contexts[order], self.escapes[order] = contexts, escape.astype(np.float32)
            less = escape[own] + self._cost(codes & ((1 << 8 * order) - 1), order - 1)
            self.codes[order], self.costs[order] = codes, np.where(counts > 0, seen, less).astype(np.float32)
        pairs = np.unique(np.r_[self.codes[3] >> 16, self.codes[3] & 0xFFFF])
        self.side = len(pairs) + 1 if len(pairs) < PAIRS else 0
        if self.side:
            self.pair = np.full(65536, len(pairs), np.int32)
            self.pair[pairs] = np.arange(len(pairs))

    @functools.cached_property
    def square(self) -> np.ndarray:
        """Row of codes[3] by the numbers of its two byte pairs; -1 where it is none."""
        out = np.full(self.side * self.side, -1, np.int32)
        c = self.codes[3]
        out[self.pair[c >> 16] * self.side + self.pair[c & 0xFFFF]] = np.arange(len(c))
        return out

    @staticmethod
    def _find(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_, keys)
        at[at == len(sorted_)] = 0
        return np.where(sorted_[at] == keys, at, -1) if len(sorted_) else np.full(len(keys), -1)

    def _cost(self, code: np.ndarray, order: int) -> np.ndarray:
        """Code lengths (positions, languages) of bytes after order bytes of context, codes of order + 1 bytes."""
        if order < 0:
            return np.full((len(code), len(self.langs)), 8.0, np.float32)
        row = self._find(self.codes[order], code)
        return self._filled(row, code, order)

    def _filled(self, row: np.ndarray, code: np.ndarray, order: int) -> np.ndarray:
        out = self.costs[order][row]
        if len(miss := np.flatnonzero(row < 0)):
            c = code[miss]
            context = self._find(self.contexts[order], c >> 8)
            leave = np.where((context >= 0)[:, None], self.escapes[order][context], 0.0)
            out[miss] = leave + self._cost(c & ((1 << 8 * order) - 1), order - 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(b"\0\0\0" + t.lower() for t in texts) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 3) - sizes - 3  # of the gram that ends at a text's first byte
        owner_ends = starts + sizes
        step = max(HELD // max(len(self.langs), 1), 1 << 12)
        for lo in range(0, int(owner_ends[-1]) if len(texts) else 0, step):
            hi = min(lo + step, len(data) - 3)
            part = data[lo : hi + 3]
            if self.side:
                two = self.pair[part[:-1].astype(np.int64) << 8 | part[1:]]
                row = self.square[two[:-2] * self.side + two[2:]]
                code = grams(part).astype(np.int64) if (row < 0).any() else None
            else:
                code = grams(part).astype(np.int64)
                row = self._find(self.codes[3], code)
            cost = self._filled(row, code, 3)
            first, last = np.searchsorted(owner_ends, lo, "right"), np.searchsorted(starts, hi, "left")
            own = np.arange(first, last)
            own = own[np.minimum(owner_ends[own], hi) > np.maximum(starts[own], lo)]
            if len(own):
                a, b = np.maximum(starts[own], lo) - lo, np.minimum(owner_ends[own], hi) - lo
                cuts = np.column_stack([a, b]).ravel()
                pad = np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)])
                out[own] += np.add.reduceat(pad, np.minimum(cuts, len(cost)), axis=0, dtype=np.float64)[::2]
        return out


@in_scratch
def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees | None:
    """Trees of the documents' languages; docs: those that may be learned from."""
    able = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = able.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__n"))
    n = counts.count()
    if not n:
        return None
    each = max(min(PER_LANGUAGE, TOTAL / n), LEAST)
    # a document is chosen if its hash is below its language's share, by all 64 bits
    part = F.when(F.col("__n") <= LEAST, 1.0).otherwise(F.least(F.lit(1.0), each / F.col("__n")))
    share = bounded(counts.select("__lang", part.alias("__part")))  # a row a language
    chosen = (F.col("__part") >= 1) | (F.xxhash64(key) < (F.col("__part") * 2.0**64 - 2.0**63).cast("long"))
    some = able.join(share, F.col(lang) == F.col("__lang")).where(chosen)
    grams_ = stash(count_grams(some.select(lang, text), lang, text), "langid-grams")
    # the tasks leave out grams that no language has often enough, so that the trees keep to CELLS
    tops = grams_.groupBy("gram").agg(F.max("n").alias("top")).groupBy(F.least("top", F.lit(1000)).alias("top")).agg(F.count("*").alias("kinds"))
    kinds, least = dict(map(tuple, tops.collect())), 1
    while n * sum(k for top, k in kinds.items() if top >= least) > CELLS and least < 1000:
        least += 1
    names = sorted((r[0] for r in counts.select("__lang").collect()), key=lambda x: x.encode())  # a row a language
    numbers = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(names)), "number int, lang string"))
    got = grams_.where(F.col("n") >= least).join(numbers, "lang").select("number", "gram", "n").toPandas()  # CELLS at most
    if not len(got):
        return None
    seen, lang_ = np.unique(got["number"].to_numpy(), return_inverse=True)
    return Trees([names[i] for i in seen], lang_, got["gram"].to_numpy(), got["n"].to_numpy(float))


def identify(docs: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every document."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        return docs.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(trees))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        trees = _trees(shared.value)
        for b in batches:
            bits = trees.bits([x or b"" for x in b.column(1).to_pylist()])
            best = bits.argmin(1)
            share = 1 / np.exp2(bits.min(1)[:, None] - bits).sum(1) if len(bits) else np.empty(0)
            known = b.column(2).to_pylist()
            pred = [trees.langs[i] if k else "und" for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0) if len(bits) else share)], names=[key, "lang_pred", "score"])
        release()

    return docs.select(key, F.col(text).cast("binary"), letter.alias("letter")).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


@functools.lru_cache(2)
def _trees(data: bytes) -> Trees:
    return pickle.loads(data)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs.where(fold_of() != 0))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
