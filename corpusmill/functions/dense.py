"""Inner products by blocks: Arrow batches of rows against one matrix of questions, for mapInArrow."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

#: Products that a task holds at once (8 bytes each).
CELLS = 1_000_000
DIGITS = 6


def matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists that aren't null as rows, and their places. All must have the width and no null element."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(there)).flatten()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)[there]
    if flat.null_count or (sizes != width).any():
        raise ValueError(f"vectors must have {width} elements, none of them null")
    return flat.to_numpy(zero_copy_only=False).reshape(len(there), width), there


def release() -> None:
    """Gives a Python worker's unused memory back to the machine; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores (questions x rows of ids) the k largest, ties by the smaller id."""
    if scores.shape[1] <= 4 * k:
        ids = np.broadcast_to(ids, scores.shape)
        at = np.lexsort((ids, -scores), axis=1)[:, :k]
        return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    # a question at a time: all that reach its k-th largest, so that ties are cut by id; no sort of the whole block
    top, names = np.empty((len(scores), k)), np.empty((len(scores), k), ids.dtype)
    for i, own in enumerate(scores):
        less = -own  # not a number comes last
        near = np.flatnonzero(~(less > np.partition(less, k - 1)[k - 1]))
        by = near[np.lexsort((ids[near], less[near]))[:k]]
        top[i], names[i] = own[by], ids[by]
    return top, names


@dataclass(frozen=True)
class Questions:
    """A block of questions as one matrix, sent to all tasks."""

    sent: Broadcast
    kind: str

    @staticmethod
    def of(block: DataFrame) -> Questions:
        """block: query_id, query_vector (array of doubles); index.BLOCK rows at most (see index.in_blocks)."""
        got = block.where("query_id is not null and query_vector is not null").toArrow()
        vectors = got.column(1).combine_chunks()
        width = len(vectors[0]) if len(vectors) else 0
        ids = got.column(0).combine_chunks()
        made = (ids, matrix(vectors, width)[0] if len(vectors) else np.empty((0, 0)))
        return Questions(block.sparkSession.sparkContext.broadcast(made), block.schema["query_id"].dataType.simpleString())

    def _products(self, batches):
        """The questions' products with batches of rows (id, vector) and the rows' ids."""
        asked = self.sent.value[1]
        step = max(CELLS // max(len(asked), 1), 1)
        for b in batches:
            b = pa.RecordBatch.from_arrays(b.columns, names=["id", "v"]).filter(b.column(0).is_valid())
            for lo in range(0, len(b) if len(asked) else 0, step):
                some = b.slice(lo, step)
                rows, there = matrix(some.column(1), asked.shape[1])
                if len(rows):
                    yield asked @ rows.T, some.column(0).to_numpy(zero_copy_only=False)[there]

    def best(self, k: int):
        """A function for mapInArrow over (id, vector): each task's k best rows of each question."""

        def run(batches):
            ids, top, names = self.sent.value[0], None, None
            for products, rows in self._products(batches):
                # products of one pair may differ in the last digits by the batch it is in
                scores, of = largest(np.round(products, DIGITS) + 0.0, rows, k)
                if top is not None:
                    scores, of = largest_of(np.c_[top, scores], np.c_[names, of], k)
                top, names = scores, of
            if top is not None:
                each = pa.array(np.repeat(np.arange(len(ids)), top.shape[1]))
                yield pa.RecordBatch.from_arrays([ids.take(each), pa.array(names.ravel()), pa.array(top.ravel())], names=["query_id", "vec_id", "cosine"])
            top = names = scores = of = products = rows = None
            release()

        return run

    def extent(self):
        """A function for mapInArrow over (id, vector): each task's largest and smallest product of each question, and its rows."""

        def run(batches):
            ids, best, worst, n = self.sent.value[0], None, None, 0
            for products, rows in self._products(batches):
                hi, lo = products.max(1), products.min(1)
                best, worst = (hi, lo) if best is None else (np.maximum(best, hi), np.minimum(worst, lo))
                n += len(rows)
            if best is not None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(best), pa.array(worst), pa.array(np.full(len(ids), n))], names=["query_id", "best", "worst", "rows"])

        return run


def largest_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """largest, where each question has rows of its own."""
    at = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
