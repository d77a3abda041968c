"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearest by Euclidean distance is largest <q, x> - |x|^2 / 2, so each vector is quantised for its inner products, with
its norm kept exactly beside the code. Vectors are taken from the sample's mean and by its extent, which changes no order
of distances: rows far from zero but close together keep their differences. Pairs of dimensions share a codebook of 16 (four bits). The codebooks are fitted
on a bounded sample for the anisotropic loss: residual error parallel to the vector weighs `eta` times as much as error
across it, since it is what moves the large inner products. Codes are chosen by coordinate descent on that loss, and the
codebooks are solved for by least squares under it.

Search: queries go in blocks of BLOCK (fewer of long vectors), each block's vectors to all tasks (a stated bound). A task
scans its rows' codes by table look-ups (two codes a byte, one table of 256 sums for each), takes each query's RERANK best
of every ROWS rows, and scores those exactly in double precision. Then it checks the codes: a row lies within the length
of its residual (kept beside the code) of the point that its code stands for, so only rows whose coded distance less that
length is at most the k-th best one can be nearer, and these are scored exactly too. Whatever the rows are like, none of
the k nearest is missed; where codes tell rows badly apart (tight clusters, a few huge vectors), more rows are scored. The
best k of each task are ranked per query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without
an id, nor vectors of another length than most have; of rows with the same id the nearest one counts, and a query that
is repeated is the least of its vectors; ties go to the smaller id; fewer candidates than k give fewer rows; an empty
table gives an empty result; other columns are left out.

Scale: every row is coded and scanned, in place; nothing of the table is shuffled but k rows a query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CODEC, least_by_hash, share_by_hash, stash, stash_path, table

#: Vectors that the codebooks are fitted on, at most (about).
SAMPLE = 8_000
#: Queries whose vectors are sent to all tasks at once (about), and bytes of their vectors at most.
BLOCK, BLOCK_BYTES = 8_192, 1 << 26
#: Bytes of look-up tables that a task holds at once: a block's queries take turns in each batch.
TABLE_BYTES = 1 << 24
#: Rows of a batch that are scored exactly for each query.
RERANK = 64
#: Rows scanned at once.
ROWS = 8_192
#: Coordinates beyond so many extents of the sample aren't coded as they are: their residual says so.
WIDEST = 1e6
#: Parallel error matters above this cosine of query and vector.
THRESHOLD = 0.2


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id long, embedding array<double> of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (most.d if most else 0))


class Quantiser:
    """Codebooks of shape (subspaces, 16, 2), and the weight of parallel error."""

    def __init__(self, d: int, eta: float):
        self.d, self.eta = d, eta
        self.m = -(-d // 2)
        self.m += self.m % 2  # two codes fill a byte
        self.books = np.zeros((self.m, 16, 2))
        self.centre, self.extent = np.zeros(d), 1.0

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors from the centre, by the extent: what is coded, and what queries are compared with."""
        return (x - self.centre) / self.extent

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The points that codes stand for."""
        return self.books[np.arange(self.m)[None], codes].reshape(len(codes), 2 * self.m)[:, : self.d]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.m - self.d))).reshape(len(x), self.m, 2)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows, subspaces): nearest centroids, then coordinate descent on |r|^2 + (eta - 1) <r, u>^2."""
        x = np.clip(x, -WIDEST, WIDEST)
        p = self._parts(x)
        u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-150)[:, None, None]
        codes = np.empty((len(x), self.m), np.uint8)
        cost, along = np.empty((self.m, len(x), 16), np.float32), np.empty((self.m, len(x), 16), np.float32)
        for j in range(self.m):
            r = p[:, j, None, :] - self.books[j][None]
            cost[j] = (r * r).sum(2)
            along[j] = (r * u[:, j, None, :]).sum(2)
            codes[:, j] = cost[j].argmin(1)
        at = np.arange(len(x))
        total = sum(along[j, at, codes[:, j]] for j in range(self.m))
        for _ in range(rounds):
            for j in range(self.m):
                rest = total - along[j, at, codes[:, j]]
                codes[:, j] = (cost[j] + (self.eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j, at, codes[:, j]]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centre = x.mean(0)
        self.extent = float(np.abs(x - self.centre).max()) or 1.0
        x = self.placed(x)
        p = self._parts(x)
        u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-150)[:, None, None]
        self.books = p[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
        for _ in range(rounds):
            codes = self.encode(x)
            at = np.arange(len(x))
            r = p - self.books[np.arange(self.m)[None], codes]
            total = (r * u).sum((1, 2))
            for j in range(self.m):
                # with the other subspaces fixed, each centroid solves a 2 x 2 system
                rest = total - (r[:, j] * u[:, j]).sum(1)
                uj, c = u[:, j], codes[:, j]
                outer = np.eye(2) + (self.eta - 1) * uj[:, :, None] * uj[:, None, :]
                goal = np.einsum("nab,nb->na", outer, p[:, j]) + (self.eta - 1) * rest[:, None] * uj
                left, right = np.zeros((16, 2, 2)), np.zeros((16, 2))
                np.add.at(left, c, outer)
                np.add.at(right, c, goal)
                used = np.bincount(c, minlength=16) > 0
                self.books[j][used] = np.linalg.solve(left[used] + 1e-9 * np.eye(2), right[used][:, :, None])[:, :, 0]
                r[:, j] = p[:, j] - self.books[j][c]
                total = rest + (r[:, j] * u[:, j]).sum(1)
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): the two inner products that a byte of two codes stands for."""
        each = np.einsum("qmd,mkd->mkq", self._parts(q), self.books).astype(np.float32)
        return (each[0::2][:, :, None] + each[1::2][:, None]).reshape(self.m // 2, 256, len(q))


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def fit(rows: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser fitted on about `sample` rows, chosen by their ids' hash."""
    n = rows.count()
    if not n:
        return None
    some = rows.where(share_by_hash("vec_id", 4 * sample / n)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    x = np.array([r.embedding for r in least_by_hash(some, "vec_id", sample).orderBy("vec_id").collect()])
    if not len(x):
        x = np.array([r.embedding for r in rows.limit(sample).collect()])
    d = x.shape[1]
    return Quantiser(d, max((d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2), 1.0)).fit(x)


#: A coded row: its codes (two of four bits a byte), half its squared length, its point's squared length, its residual's length.
CODED = "vec_id long, embedding array<double>, code binary, half double, point double, off double"


def index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """rows as CODED, lengths as quantiser.placed measures them."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS // 4):
                b = batch.slice(at, ROWS // 4)
                x = quantiser.placed(b.column(1).flatten().to_numpy().reshape(len(b), -1))
                codes = quantiser.encode(x)
                points, packed = quantiser.decoded(codes), pack(codes)
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(b), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                lengths = [(x * x).sum(1) / 2, (points * points).sum(1), np.linalg.norm(x - points, axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), whole, *map(pa.array, lengths)], names=["vec_id", "embedding", "code", "half", "point", "off"])

    return rows.mapInArrow(run, CODED)


def _nearer(est: np.ndarray, point: np.ndarray, off: np.ndarray, x: np.ndarray, half: np.ndarray, q: np.ndarray, kth: np.ndarray, subspaces: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and a mask (rows, queries): all that may lie within kth of a query.

    est: the codes' inner products with the queries. A row is at least as far as its point less its residual; of rows that
    pass, those whose product in double precision shows that they are farther go too. Both leave room for rounding, and
    what overflows passes.
    """
    q2 = (q * q).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        both = (point[:, None] + q2[None]).astype(np.float32)
        lower = np.sqrt(np.maximum(both * np.float32(1 - 2.4e-7 * (subspaces + 8)) - 2 * est, 0))
        lower -= (off * (1 + 1e-5))[:, None].astype(np.float32)
        passed = ~(lower > (kth * (1 + 1e-5))[None].astype(np.float32)) | (np.abs(q).max(1) > WIDEST)[None]
        at = np.flatnonzero(passed.any(1))
        both = 2 * half[at, None] + q2[None]
        return at, passed[at] & ~(both * (1 - 1e-12) - 2 * x[at] @ q.T > (kth * kth * (1 + 1e-9))[None])


def _scan(indexed: DataFrame, ids: np.ndarray, q: np.ndarray, quantiser: Quantiser, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k nearest for each query."""
    shared = indexed.sparkSession.sparkContext.broadcast((ids, q, quantiser))

    def run(batches):
        ids, q, quantiser = shared.value
        placed = quantiser.placed(q)
        turn = max(1, min(256, TABLE_BYTES // (quantiser.m // 2 * 256 * 4)))
        best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

        def scored(i, near, key, x):
            near = near[key[near] != ids[i]]
            away = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            away, to = np.r_[best[i][0], away], np.r_[best[i][1], key[near]]
            by = np.lexsort((to, away))
            _, first = np.unique(to[by], return_index=True)
            by = by[np.sort(first)][:k]
            best[i] = away[by], to[by]

        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                key = part.column(0).to_numpy()
                order = np.argsort(key, kind="stable")
                key = key[order]
                x = part.column(1).flatten().to_numpy().reshape(len(part), -1)[order]
                own = quantiser.placed(x)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)[order]
                half, point, off = (part.column(c).to_numpy()[order] for c in (3, 4, 5))
                for lo in range(0, len(ids), turn):
                    asked = placed[lo : lo + turn]
                    tables = quantiser.tables(np.clip(asked, -WIDEST, WIDEST))
                    est = np.zeros((len(part), len(asked)), np.float32)
                    for j in range(code.shape[1]):
                        est += tables[j][code[:, j]]
                    score = np.ascontiguousarray((est - np.minimum(half, 1e37).astype(np.float32)[:, None]).T)
                    for i, s in enumerate(score, start=lo):
                        take = min(RERANK, len(s))
                        edge = np.partition(s, len(s) - take)[len(s) - take]
                        above = np.flatnonzero(s > edge)
                        # of rows with the same score (equal vectors have), those of least id come first
                        scored(i, np.r_[above, np.flatnonzero(s == edge)[: take - len(above) + 1]], key, x)
                    kth = np.array([best[i][0][k - 1] if len(best[i][0]) >= k else np.inf for i in range(lo, lo + len(asked))]) / quantiser.extent
                    rows, may = _nearer(est, point, off, own, half, asked, kth, quantiser.m)
                    for i in np.flatnonzero(may.any(0)):
                        scored(lo + i, rows[may[:, i]], key, x)
        if any(len(x[0]) for x in best):
            counts = [len(x[0]) for x in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))],
                names=["query_id", "vec_id", "score"],
            )

    return indexed.mapInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (a row of the same id isn't a candidate)."""
    spark = rows.sparkSession
    rows = valid(rows, key, vector)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = fit(rows, sample)
    if quantiser is None:
        return empty
    asked = valid(queries, key, vector).where(F.size("embedding") == quantiser.d)
    asked = stash(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    n = asked.count()
    if not n:
        return empty
    indexed = stash(index(rows, quantiser), "ann-index")
    blocks = -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * quantiser.d))))
    path = stash_path(spark, "ann-found")
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        if own:
            got = _scan(indexed, np.array([r.vec_id for r in own]), np.array([r.embedding for r in own]), quantiser, k)
            got.write.mode("append").option("compression", CODEC).parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = best.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"), 10)
