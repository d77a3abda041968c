"""What the operators share: the shared folder, stored intermediate tables and joins of a checked size."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import CODEC, clear_stash, discard, fresh, scratch, shared_dir, stash, stash_path  # noqa: F401

#: Rows up to which a narrow table (a few numbers or short strings a row) is broadcast.
BROADCAST_ROWS = 200_000


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most so many rows, else as it is (a shuffled join, which AQE splits)."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out anew where it is so small that its files keep less than the session's cores busy.

    A table of at least as many splits as cores is read as it is, so nothing large is ever shuffled for this.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_scratch(learn):
    """A function of a first frame that gives no frame: what it stores is deleted once it has returned."""

    @functools.wraps(learn)
    def run(df, *rest, **named):
        with scratch(df.sparkSession, learn.__name__):
            return learn(df, *rest, **named)

    return run


def fold_of(key: str = "doc_id", folds: int = 5):
    """crc32 of the key's text, modulo folds; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % F.lit(folds)


#: Words of 64 bits that a sieve has: at most so many rows of two longs are sent to all tasks.
SIEVE_WORDS = 1 << 20


def sieved(rows: DataFrame, name, wanted: DataFrame, wanted_name, words: int = SIEVE_WORDS) -> tuple[DataFrame, DataFrame]:
    """rows parted into those whose name (a hash, a long) surely isn't among the wanted ones', and those where it may be.

    For joins that concern few rows of a wide table: only the second part needs to be shuffled. A blocked Bloom filter of a
    fixed size is sent to all tasks: a hash names a word and three bits of it. The more names are wanted, the more rows are
    in the second part, at last all of them; what a join makes of the two parts is the same at every size.
    """
    def place(h):
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(63).cast("int"))
        return h.bitwiseAND(words - 1), bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))

    slot, bits, word = (fresh(rows.columns, x) for x in ("__slot", "__bits", "__word"))
    at, mask = place(wanted_name)
    table_ = wanted.select(at.alias(slot), mask.alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    table_ = stash(table_, "sieve")  # a row a word at most
    at, mask = place(name)
    held = rows.withColumns({word: at, fresh(rows.columns, "__mask"): mask})
    mask = F.col(fresh(rows.columns, "__mask"))
    held = held.join(F.broadcast(table_.withColumnRenamed(slot, word)), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
    return held.where(~hit).select(*rows.columns), held.where(hit).select(*rows.columns)


def keep_rows(docs: DataFrame, text: str, others: list[str], judge, rows: int = 1024) -> DataFrame:
    """The rows of docs that judge keeps, in one scan: judge gets lists of the texts (bytes) and others, gives booleans."""
    schema, first, at = docs.schema, docs.columns.index(text), [docs.columns.index(c) for c in others]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for lo in range(0, len(whole), rows):
                b = whole.slice(lo, rows)
                texts = [x or b"" for x in b.column(first).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(judge(texts, *(b.column(i).to_pylist() for i in at)), pa.bool_()))
        release()

    return docs.mapInArrow(run, schema)


def least_by_hash(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows whose key's hash is least: a sample that is the same however the rows lie, n rows a task at most."""
    order = fresh(rows.columns, "__hash")
    return rows.withColumn(order, F.xxhash64(F.lit(seed), key)).orderBy(order, key).limit(n).drop(order)


def share_by_hash(key, share: float, seed: int = 0):
    """True for about that share of the keys, by all 64 bits of their hash."""
    return F.xxhash64(F.lit(seed), key) < int(-(2**63) + share * 2**64) if share < 1 else F.lit(True)


def share_of(hash_):
    """A number in [0, 1) from a hash (a long)."""
    return F.shiftrightunsigned(hash_, 11) / F.lit(float(2**53))


def one_each(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each key, that of the least text by hash: partial by task, so a key with many rows is a row a task."""
    whole = F.struct(F.xxhash64(text).alias("h"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(whole["row"], whole["h"]).alias("__row")).select("__row.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text"):
    """At most `per_class` documents of each label, those of least id by hash, stored: docs' columns and __label.

    Labels are 0 and 1: others and null ones don't count. Null texts and ids aren't chosen, nor labels of other documents;
    of several labels of an id the largest counts, and of several rows of an id the least text by hash. Also the number of labelled ids of each label, to weigh
    the classes by.
    """
    spark = docs.sparkSession
    with scratch(spark, "sampling"):
        known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        known = known.groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
        able = docs.where(F.col(text).isNotNull())
        known = able.select(F.col(key).alias("__key")).join(bounded(stash(known, "labels")), "__key").distinct()
        known = stash(known, "labelled")
        counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
        chosen = None
        for value in sorted(counts):
            own = least_by_hash(known.where(F.col("__label") == value), "__key", per_class)
            chosen = own if chosen is None else chosen.unionAll(own)
        if chosen is None:
            chosen = known
        some = able.join(F.broadcast(stash(chosen, "chosen")), F.col(key) == F.col("__key")).drop("__key")  # per_class rows a label
        return stash(one_each(some, key, text).repartition(spark.sparkContext.defaultParallelism), "sample", outer=True), counts


def logistic(x, y, weight=None, ridge: float = 1.0, rounds: int = 60):
    """Weights of a logistic regression (the last one the intercept, which isn't shrunk), by Newton steps."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    w, shrink = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (weight * (p - y)) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def release() -> None:
    """Gives a Python worker's unused memory back to the machine; workers are reused by later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
