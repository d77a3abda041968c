"""Periodic runs of words, by names of power-of-two lengths (Karp, Miller and Rosenberg), in NumPy.

Words of a block of documents are one sequence, with a separator of its own between documents. Level k names the
stretches of 2^k words: two get the same name when they are equal and of one document. A level's names come from sorting
pairs of the one below; stretches that don't repeat keep names of their own and aren't sorted again, so ordinary text
drops out after a few levels, and no level is made once nothing repeats.

A run of period q has at least R = max(least, repeats * q) - q places i whose word equals that at i + q, in a row, so it
holds one whole cell of a grid of steps (R + 1) // 2. Cells are candidates if the names of their halves, of the largest
power of two, are equal q words on. A candidate is extended to both sides by its longest common extension (LCE): levels are
tried in descending order, and each equal name steps over its length. No hash is taken and no suffix is sorted. Stretches
found by several q have the least as period (by Fine and Wilf's theorem all others are its multiples).

Defined cases: a null text has no words; texts of any length are taken whole, with 4 bytes a word and level; repeated rows
are rows of their own; an empty table gives an empty result; other columns pass through, except that columns named
n_words, runs or collapsed are replaced. Nothing is shuffled: documents don't influence each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .bpe import slices, spread
from .common import release, table

#: Bytes of text whose words are named together; a larger text stands alone.
BLOCK = 2_000_000
#: Candidates that are looked at together.
CELLS = 1_000_000
RUN = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())]))


def levels(names: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of each level (equal and not negative for equal stretches), and the last level at which a document repeats.

    names: a number a word, separators negative and distinct; doc: the document of each place. Each level's last entry
    is a place beyond the end, with a name of its own.
    """
    n = len(names)
    top = np.full(n_docs, -1, np.int64)
    at = np.flatnonzero(names >= 0)
    key = doc[at].astype(np.int64) * (int(names.max(initial=0)) + 1) + names[at]
    out: list[np.ndarray] = []
    while len(at):
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        live = count[which] > 1
        at, which = at[live], which[live]
        if not len(at):
            break
        level = -np.arange(1, n + 2, dtype=np.int64 if n > 2**31 - 4 else np.int32)
        level[at] = which
        top[doc[at]] = len(out)
        step = 1 << len(out)
        out.append(level)
        after = np.minimum(at + step, n)
        pair = level[after] >= 0
        at = at[pair]
        key = level[at].astype(np.int64) * (int(which.max()) + 1) + level[after[pair]]
    return out, top


def lce(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places i < j the number of equal words from them on, and of those before them."""
    n = len(names[0]) - 1
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        level, step = names[k], 1 << k
        ahead += step * (level[i + ahead] == level[np.minimum(j + ahead, n)])
        left = i - back - step
        back += step * ((left >= 0) & (level[left] == level[j - back - step]))
    return ahead, back


def find(names: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """The runs of documents at starts, of sizes, in the sequence: rows of document, start in it, length, period, sorted."""
    doc = np.full(len(names), -1, np.int64)
    doc[spread(starts, sizes)] = np.repeat(np.arange(len(starts)), sizes)
    named, top = levels(names, doc, len(starts))
    # periods of each document, as far as a grid cell's halves can be equal
    most = np.where(sizes >= least, sizes // repeats, 0)
    owner, period = np.repeat(np.arange(len(starts)), most), spread(np.ones_like(most), most).astype(np.int64)
    cell = (np.maximum(least, repeats * period) - period + 1) // 2
    half = np.frexp(cell)[1] - 1  # the largest power of two in it
    able = half <= top[owner]
    owner, period, cell, half = owner[able], period[able], cell[able], half[able]
    cells = (sizes[owner] - period) // cell
    found = [np.empty((0, 4), np.int64)]
    for lo, hi in slices(cells, CELLS):
        n = cells[lo:hi]
        each = np.repeat(np.arange(lo, hi), n)
        q, own, k = period[each], owner[each], half[each]
        i = starts[own] + (spread(np.zeros_like(n), n) * cell[each])
        keep = np.zeros(len(i), bool)
        for level in np.unique(half[lo:hi]).tolist():
            at = np.flatnonzero(k == level)
            name, a = named[level], i[at]
            at = at[name[a] == name[a + q[at]]]
            a = i[at] + cell[each[at]] - (1 << level)
            keep[at[name[a] == name[a + q[at]]]] = True
        i, q, own = i[keep], q[keep], own[keep]
        ahead, back = lce(named, i, i + q)
        length = ahead + back + q
        keep = length >= np.maximum(least, repeats * q)
        found.append(np.unique(np.c_[own, i - back - starts[own], length, q][keep], axis=0))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)  # of the periods of a stretch the least
    first[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def judged(texts: list[bytes], keys: list, rewrite, least: int, repeats: int):
    """For each text its number of words, its runs and the text without the repeats of its runs."""
    words = [t.split() for t in texts]  # bytes are split at \\x20 and \\x09 to \\x0D
    number = {w: i for i, w in enumerate(set().union(*words))} if words else {}
    vocabulary = list(number)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    names = -np.arange(1, int((sizes + 1).sum()) + 1, dtype=np.int64)
    for at, own in zip(starts.tolist(), words):
        names[at : at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    changed = set()
    for d, key in enumerate(keys if rewrite else []):
        n = len(words[d])
        if n and (tail := rewrite(key, n)):
            a, p = tail
            own = names[starts[d] : starts[d] + n]
            own[a:] = own[a + np.arange(n - a) % p]
            changed.add(d)
    rows = find(names, starts, sizes, least, repeats)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
    for d, own in enumerate(words):
        runs = rows[cuts[d] : cuts[d + 1], 1:]
        if len(runs):
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            kept = names[starts[d] : starts[d] + len(own)][np.cumsum(edge[:-1]) == 0]
            own = [vocabulary[i] for i in kept.tolist()]
        elif d in changed:
            own = [vocabulary[i] for i in names[starts[d] : starts[d] + len(own)].tolist()]
        yield len(words[d]), runs, b" ".join(own)


def with_runs(docs: DataFrame, text: str = "text", least: int = 24, repeats: int = 3, key: str | None = None, rewrite=None) -> DataFrame:
    """docs without text, with n_words, runs (start, length, period, by start and period) and collapsed.

    A run is a stretch of words of smallest period q, of at least max(least, repeats * q) words, that no neighbouring word
    extends; repeats is 2 at least. collapsed: the words (UTF-8, joined by one space) that no run contains after its first q.
    rewrite(key, n), if given, names for a text of n words a place a and a p: from word a on its p words there repeat.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run repeats its period")
    new = ["n_words", "runs", "collapsed"]
    docs = docs.drop(*(c for c in new if c != text))
    keep = [c for c in docs.columns if c != text]
    at, named = docs.columns.index(text), docs.columns.index(key) if key else None
    fields = [StructField("n_words", LongType()), StructField("runs", RUN), StructField("collapsed", BinaryType())]

    def run(batches):
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy()
            for lo, hi in slices(sizes, BLOCK):
                b = whole.slice(lo, hi - lo)
                texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
                keys = b.column(named).to_pylist() if key else [None] * len(texts)
                counts, runs, collapsed = [], [], []
                for n, found, rest in judged(texts, keys, rewrite, least, repeats):
                    counts.append(n)
                    runs.append(found)
                    collapsed.append(rest)
                flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
                ends = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32))
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
                done = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array(collapsed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *done], names=[*keep, *new])
        release()

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *fields]))


def periodic_tail(doc_id, n: int) -> tuple[int, int] | None:
    """The tail that a tenth of the documents (by crc32 of the id; never a null one) repeats."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def digest(runs):
    """SHA-256 of the lines start,length,period of all runs."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.sha2(F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256)


def strongest(runs):
    """The run of the greatest length / period, compared exactly; of equal ones the first by start, then period."""
    wide = lambda c: c.cast("decimal(19,0)")
    better = lambda r, best: wide(r["length"]) * wide(best["period"]) > wide(best["length"]) * wide(r["period"])
    first = F.element_at(runs, 1)
    fold = F.aggregate(runs, first, lambda best, r: F.when(better(r, best), r).otherwise(best))
    return F.when(F.size(runs) > 0, fold)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = with_runs(docs, key="doc_id", rewrite=periodic_tail)
    most = F.col("most")
    return done.withColumn("most", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        most["start"].alias("start"),
        most["length"].alias("length"),
        most["period"].alias("period"),
        F.floor(1000 * most["length"].cast("decimal(19,0)") / most["period"]).cast("long").alias("exponent_milli"),
        digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
