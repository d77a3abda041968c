"""A training-data pipeline over documents: five stages, each written as Parquet and reread as the next one's documents.

Every stage works on all that its predecessor kept. The classifiers learn from the labelled documents among their input
whose fold isn't held out (see corpusmill.llm.quality and corpusmill.llm.toxicity for their bounds).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, mixing, quality, simhash, toxicity
from corpusmill.llm.common import discard, scratch, stash, table
from corpusmill.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _zstd(stage):
    """The stage, with zstd as the session's Parquet codec for what it returns.

    Pages of long texts are large. Snappy (de)compresses them in direct buffers that stay until the JVM collects its
    garbage, which a stage that works in Python seldom makes it do; zstd's buffers are freed with the page.
    """

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        ship(spark)
        spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
        return stage(spark, docs, sf_dir)

    return run


@_zstd
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


@_zstd
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


@_zstd
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each near-duplicate component stays, the one of the least id."""
    return simhash.near_dedup(docs.select(*COLUMNS))


@_zstd
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as its source's rate and its draw say (a row a copy)."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


@_zstd
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the token ids of each copy, and digests that tie them to the text they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding", bpe_stage),
]

#: The classifiers, fingerprints and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored on its way goes with it, and its result once the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark, f"stage-{i}"):
            done = stash(stage(spark, docs, sf_dir), f"pipeline-{i}", outer=True)
        discard(docs)
        docs = done
    return docs
