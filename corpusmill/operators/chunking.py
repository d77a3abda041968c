"""Chunks of records, with the token counter as an argument."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class WordCounter:
    """Counts and cuts by the lexical index's tokens, as column expressions."""

    def counts(self, units: Column) -> Column:
        return F.transform(units, lambda u: F.size(T.tokens(u)))

    def cut(self, units: Column, target: int, most: int) -> Column:
        return T.cut_long(units, target, most)


@functools.lru_cache(4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BpeCounter:
    """Counts and cuts by the tokens of a byte-level BPE vocabulary.

    path: a .tiktoken file that every executor has (public vocabularies are a parameter, never part of this package);
    pattern: the regular expression that parts a text to words. No built-in function encodes, so these are pandas UDFs.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def counts(self, units: Column) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("array<int>")
        def run(rows: pd.Series) -> pd.Series:
            encode = _encoding(path, pattern).encode_ordinary
            return rows.map(lambda us: None if us is None else [len(encode(u)) for u in us])

        return run(units)

    def cut(self, units: Column, target: int, most: int) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("array<string>")
        def run(rows: pd.Series) -> pd.Series:
            own = _encoding(path, pattern)

            def parts(u):
                ids = own.encode_ordinary(u)
                return [u] if len(ids) <= most else [own.decode(ids[i : i + target]) for i in range(0, len(ids), target)]

            return rows.map(lambda us: None if us is None else [p for u in us for p in parts(u)])

        return run(units)


def chunks(records: DataFrame, counter=None, target: int = 550, most: int = 700, key: str = "record_id", text: str = "text") -> DataFrame:
    """Rows of records as chunks: chunk_id, chunk_index, chunk_count, text and token_count beside the other columns.

    A record stays whole if it is current (source_type `current_guideline`) or has at most `most` tokens; others are cut to
    units (lines of a table: content_type `evidence_table`) and packed towards `target`. Records whose retrieval_eligible
    isn't true are dropped. Records without these columns are eligible, not current and no tables. A null text is an empty
    one. counter: WordCounter or BpeCounter, or anything with counts and cut.
    """
    counter = counter or WordCounter()
    flag = lambda name, test: test(F.col(name)) if name in records.columns else F.lit(False)
    if "retrieval_eligible" in records.columns:
        records = records.where("retrieval_eligible")
    rest = [c for c in records.columns if c not in (text, "chunk_id", "chunk_index", "chunk_count", "token_count")]
    whole = F.coalesce(flag("source_type", lambda c: c == "current_guideline"), F.lit(False))
    table = F.coalesce(flag("content_type", lambda c: c == "evidence_table"), F.lit(False))
    out = records.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_text"), whole.alias("_whole"), table.alias("_table"))
    out = out.withColumn("_n", F.element_at(counter.counts(F.array("_text")), 1))
    keep = F.col("_whole") | (F.col("_n") <= most)
    units = F.when(keep, F.array("_text")).otherwise(T.logical_units("_text", F.col("_table")))
    out = out.withColumn("_keep", keep).withColumn("_units", units).drop("_text", "_table", "_whole")
    out = out.withColumn("_units", F.when(F.col("_keep"), F.col("_units")).otherwise(counter.cut(F.col("_units"), target, most)))
    out = out.withColumn("_sizes", F.when(F.col("_keep"), F.array("_n")).otherwise(counter.counts(F.col("_units"))))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("n")))
    out = out.withColumn("_parts", F.when(F.col("_keep"), one).otherwise(T.packed("_sizes", target, most)))
    out = out.select(*rest, "_units", F.size("_parts").alias("chunk_count"), F.posexplode("_parts").alias("_at", "_part"))
    out = out.withColumn(text, F.array_join(F.slice("_units", F.col("_part.start") + 1, F.col("_part.n")), "\n"))
    out = out.withColumn("chunk_index", F.col("_at") + 1).withColumn("token_count", F.element_at(counter.counts(F.array(text)), 1))
    return out.withColumn("chunk_id", F.format_string("%s_c%02d", key, "chunk_index")).drop("_units", "_at", "_part")


def oversize(chunked: DataFrame, most: int = 700) -> DataFrame:
    """Whole records of over `most` tokens: their keys and sizes."""
    return chunked.where((F.col("chunk_count") == 1) & (F.col("token_count") > most))
