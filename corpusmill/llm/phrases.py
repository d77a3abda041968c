"""Phrase collocations from word-id suffix arrays.

A shard is a block of a task's texts. Its pieces are one sequence of word ids (a number a language and word), with breaks
between pieces. The suffixes are sorted by their first 2 and 4 words by prefix doubling: ranks of pairs of ranks, in NumPy.
Neighbours in that order share so many words (the LCP array), and the intervals of an LCP of at least m are the m-grams of
the shard with their counts, which Spark sums by (language, phrase). Longer common prefixes are of no use, as phrases have
LONGEST words at most, so doubling ends there.

All counts are exact. What is sent to be summed is cut level by level: a phrase of m words that occurs `least` times has
only parts that do. After the words, a filter of a fixed size (BITS bits, blocked, two bits a name) that holds all frequent
words goes to the tasks, and words it lacks become breaks; after the pairs, another one, and the stretches of pairs it holds
are the shards of the third scan. What the filters let through in error is counted like the rest and falls below `least`;
when they are full, more is sent and the result is the same.

Defined cases: a null text is an empty one; a null language is `und`; words and pieces may be of any length (long texts
are taken in stretches, with the words before each carried over); repeated rows count each; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import spread
from .common import release, scratch, stash, table

#: Words of the longest phrases.
LONGEST = 4
#: Bytes of text in a shard.
SHARD = 4_000_000
#: Bits of a filter of frequent phrases, as words of 64 bits (8 MB).
BITS = 1 << 26
#: Rows of counts in a batch.
ROWS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lower-cased, tabs as spaces, everything that ends a piece as a line feed (which no word holds).
MARKS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER[c] for c in range(256))


def stretches(text: bytes, most: int | None = None):
    """The marked text in parts that end at a space or break, each with the words before it that phrases may begin with."""
    text, lo, lead, most = text.translate(MARKS).replace(b"\n", b" \n "), 0, [], most or SHARD
    while len(text) - lo > most:
        cut = text.rfind(b" ", lo + 1, lo + most)
        if cut < 0:
            cut = text.find(b" ", lo + most)
        if cut < 0:
            break
        yield lead, text[lo:cut]
        lead = [w for w in [*lead, *text[lo:cut].split(b" ")] if w][1 - LONGEST :]
        lo = cut
    yield lead, text[lo:]


def spread_hash(h: np.ndarray) -> np.ndarray:
    """The bits of a number, mixed (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return spread_hash(first * MIX + second)


def word_names(langs: list[str], words: pa.Array, lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A number for each pair of a language and a word, by their places in the two lists."""
    hashed = lambda x: pd.util.hash_array(np.array(x, object), categorize=False)
    return pair_name(hashed(langs)[lang], hashed(words.to_pylist())[word])


def place(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a name belongs to, and its two bits there."""
    names = spread_hash(names)
    one = np.uint64(1)
    bits = (one << (names >> np.uint64(58))) | (one << ((names >> np.uint64(52)) & np.uint64(63)))
    return (names & np.uint64(BITS // 64 - 1)).astype(np.int64), bits


def held(filter_: np.ndarray, names: np.ndarray) -> np.ndarray:
    at, bits = place(names)
    return filter_[at] & bits == bits


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The filter of the names of lang and phrase: built by the tasks, joined by bits; BITS / 64 rows of two longs at most."""

    def run(batches):
        own = np.zeros(BITS // 64, np.uint64)
        for b in batches:
            langs, words = b.column(0).dictionary_encode(), pc.split_pattern(b.column(1), " ")
            sizes, first = words.value_lengths().to_numpy(), words.offsets.to_numpy()[:-1]
            words, lang = words.values.dictionary_encode(), langs.indices.to_numpy()
            word, known = words.indices.to_numpy(), langs.dictionary.to_pylist()
            names = word_names(known, words.dictionary, lang, word[first])
            for k in range(1, int(sizes.max(initial=0))):
                more = np.flatnonzero(sizes > k)
                names[more] = pair_name(names[more], word_names(known, words.dictionary, lang[more], word[first[more] + k]))
            at, bits = place(names)
            np.bitwise_or.at(own, at, bits)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], names=["slot", "bits"])
        release()

    rows = frequent.select("lang", "phrase").mapInArrow(run, "slot long, bits long")
    rows = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def suffix_ranks(ids: np.ndarray, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ids by the first `words` words (1, 2 or 4), and the ranks by 1, 2, ... words.

    A rank is one number for equal prefixes and grows with their order; beyond the end all is as the least one.
    """
    ranks, width = [ids], 1
    order = None
    while width < words:
        rank = ranks[-1]
        after = np.zeros_like(rank)
        after[: len(rank) - width] = rank[width:]
        code = rank * np.int64(int(rank.max(initial=0)) + 1) + after
        order = np.argsort(code)
        grows = np.r_[False, code[order[1:]] != code[order[:-1]]]
        new = np.empty_like(rank)
        new[order] = np.cumsum(grows)
        ranks.append(new)
        width *= 2
    return np.argsort(ids) if order is None else order, ranks


def lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """For each suffix in order how many words (up to the ranks' width) it shares with the one before it."""
    a, b, end = order[:-1], order[1:], len(order) - 1
    shared = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        shared += (1 << k) * (ranks[k][np.minimum(a + shared, end)] == ranks[k][np.minimum(b + shared, end)])
    shared[ranks[-1][a] == ranks[-1][b]] = 1 << (len(ranks) - 1)
    return np.r_[0, shared]


def grams(ids: np.ndarray, fresh: np.ndarray, orders: list[int]):
    """For each m of orders the start of one occurrence of each m-gram without a break (0), and its count.

    fresh: the place of the last word of an m-gram must be one of these, else it was counted with the stretch before.
    """
    width = 1 << (max(orders) - 1).bit_length()
    ids, fresh = np.r_[ids, np.zeros(width, ids.dtype)], np.r_[fresh, np.zeros(width, bool)]  # nothing runs over the end
    order, ranks = suffix_ranks(ids, width)
    shared = lcp(order, ranks)
    whole = ids > 0
    for m in range(1, max(orders) + 1):
        if m > 1:
            whole = whole[: len(ids) - m + 1] & (ids[m - 1 :] > 0)
        if m not in orders or not len(whole):
            continue
        fits = np.zeros(len(ids), bool)
        fits[: len(whole)] = whole & fresh[m - 1 :]
        edge = shared < m  # an interval begins
        interval = np.cumsum(edge) - 1
        ok = fits[order]
        count = np.bincount(interval[ok], minlength=int(interval[-1]) + 1 if len(interval) else 0)
        some = np.zeros(len(count), np.int64)
        some[interval[ok]] = order[ok]
        kept = np.flatnonzero(count)
        yield m, some[kept], count[kept]


def numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, of 0 to size - 1, in order (0 always among them), and the place of each code among them."""
    if size > max(8 * len(codes), 1 << 20):
        distinct, at = np.unique(np.r_[0, codes], return_inverse=True)
        return distinct, at[1:]
    there = np.zeros(size, bool)
    there[codes] = there[0] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[codes]


class Shards:
    """Blocks of texts as word ids, with what is counted in each."""

    def __init__(self, orders: list[int], words: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.orders, self.words, self.pairs = orders, words, pairs

    def blocks(self, batches):
        """Lists of (lang, lead, stretch) of about SHARD bytes."""
        out, size = [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for lead, part in stretches(text or b""):
                    if size and size + len(part) > SHARD:
                        yield out
                        out, size = [], 0
                    out.append((lang, lead, part))
                    size += len(part)
        if out:
            yield out

    def run(self, batches):
        for block in self.blocks(batches):
            yield from self.counted(*_numbers(block))
            release()

    def counted(self, ids, fresh, langs, known, lang, word, totals):
        """Counts in a block: ids are places in lang and word, which are places in langs and known."""
        if self.words is not None:
            names = word_names(langs, known, lang, word)
            there = held(self.words, names)
            there[0] = False
            ids = np.where(there[ids], ids, 0)
        if self.pairs is not None:
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(both)
            on = np.zeros(len(ids), bool)  # the pair that begins here may be frequent
            on[at] = held(self.pairs, pair_name(names[ids[at]], names[ids[at + 1]]))
            # stretches of such pairs, each ended by a break
            inside = on.copy()
            inside[1:] |= on[:-1]
            kept = np.flatnonzero(inside)
            gap = (~on[kept]).astype(np.int32)
            slot = np.arange(len(kept)) + np.cumsum(gap) - gap
            new = np.zeros(len(kept) + int(gap.sum()), ids.dtype)
            mark = np.zeros(len(new), bool)
            new[slot], mark[slot] = ids[kept], fresh[kept]
            ids, fresh = new, mark
        of_lang, spelled = pa.array(langs, pa.string()), pa.array(known, pa.string())
        for m, at, count in grams(ids, fresh, self.orders) if len(ids) else ():
            for lo in range(0, len(at), ROWS):
                some = at[lo : lo + ROWS]
                phrase = [spelled.take(pa.array(word[ids[some + k]])) for k in range(m)]
                phrase = pc.binary_join_element_wise(*phrase, " ") if m > 1 else phrase[0]
                yield _rows(of_lang.take(pa.array(lang[ids[some]])), phrase, m, count[lo : lo + ROWS])
        if self.words is None:
            yield _rows(of_lang, pa.array([""] * len(langs), pa.string()), 0, totals)


def _rows(lang, phrase, m: int, count: np.ndarray) -> pa.RecordBatch:
    columns = [lang, phrase, pa.array(np.full(len(count), m, np.int32)), pa.array(count, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "m", "f"])


def _numbers(block: list) -> tuple:
    """A block's words as numbers: what `Shards.counted` takes."""
    langs: dict[str, int] = {}
    lang = np.array([langs.setdefault(a, len(langs)) for a, _, _ in block], np.int32)
    leads = np.array([len(lead) for _, lead, _ in block], np.int64)
    texts = pa.array([b" ".join([*lead, part, b"\n"]) for _, lead, part in block], pa.binary()).cast(pa.string())
    words = pc.split_pattern(texts, " ")
    counts, first = words.value_lengths().to_numpy(), words.offsets.to_numpy()[:-1]
    words = words.values.dictionary_encode()
    word, known = words.indices.to_numpy(), words.dictionary
    fresh = np.ones(len(word), bool)
    fresh[spread(first, leads)] = False
    there = word != pc.index(known, "").as_py()
    word, lang, fresh = word[there], np.repeat(lang, counts)[there], fresh[there]
    # a number from 1 on for each pair of a language and a word; 0 is a break
    codes = np.where(word == pc.index(known, "\n").as_py(), 0, lang * np.int64(len(known)) + word + 1)
    pairs, ids = numbered(codes, len(langs) * len(known) + 1)
    totals = np.bincount(lang[(ids > 0) & fresh], minlength=len(langs))
    pairs -= 1
    return ids.astype(np.int32), fresh, list(langs), known, pairs // len(known), pairs % len(known), totals


COUNTED = "lang string, phrase string, m int, f long"


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> DataFrame:
    """lang, phrase, m (its words), f: all phrases of up to LONGEST words that occur `least` times in a language, exactly.

    Rows with m = 0 and an empty phrase hold the language's words in all. Stored (a row for `least` words at most a level).
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string"))

    def summed(rows, name):
        rows = rows.groupBy("lang", "phrase").agg(F.max("m").alias("m"), F.sum("f").alias("f"))
        return stash(rows.where((F.col("f") >= least) | (F.col("m") == 0)), name)

    words = summed(_counted(source, [1]), "words")
    known = context.broadcast(filter_of(words.where("m = 1")))
    pairs = summed(_counted(source, [2], known), "pairs")
    both = context.broadcast(filter_of(pairs))
    longer = summed(_counted(source, list(range(3, LONGEST + 1)), known, both), "longer")
    return words.unionAll(pairs).unionAll(longer)


def _counted(source: DataFrame, orders: list[int], words=None, pairs=None) -> DataFrame:
    """The counts of each shard. Without filters the languages' words are counted too."""

    def run(batches):
        return Shards(orders, words and words.value, pairs and pairs.value).run(batches)

    return source.mapInArrow(run, COUNTED)


def scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, score of phrases of 2 words and more: of their cuts the one of least score, the first of equal ones."""
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    whole = counted.where("m >= 2").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    k = F.col("k")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "m", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("m") - k).alias("rest"))
    parts = counted.where(f"m between 1 and {LONGEST - 1}")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")
    best = cuts.groupBy("lang", "phrase").agg(F.first("m").alias("m"), F.first("a").alias("a"), least)
    return best.select("lang", "phrase", "m", "a", "s.l", "s.r", "s.score")


def contained(counted: DataFrame, share: int = 80) -> DataFrame:
    """lang, phrase of those within a longer phrase that occurs at least share in 100 times as often."""
    longer = counted.where("m >= 3").withColumn("w", F.split("phrase", " "))
    spans = F.array(*(F.when(F.lit(lo + n) <= F.col("m"), F.array_join(F.slice("w", lo + 1, n), " ")) for n in range(2, LONGEST) for lo in range(LONGEST - n + 1)))
    spans = F.filter(spans, lambda s: s.isNotNull() & (s != F.col("phrase")))
    most = longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    short = counted.where(f"m between 2 and {LONGEST - 1}").join(most, ["lang", "phrase"])
    return short.where(F.lit(100) * wide("most") >= F.lit(share) * wide("f")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    with scratch(docs.sparkSession, "phrases"):
        counted = counts(docs, text, lang, least)
        rest = scored(counted).join(contained(counted, share), ["lang", "phrase"], "left_anti")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        total = counted.where("m = 0").select("lang", F.col("f").alias("n"))
        best = best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return stash(best, "collocations", outer=True)


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
flat AS (SELECT p, lang, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM worded),
led AS (SELECT lang, w0, lead(w0, 1) OVER x AS w1, lead(w0, 2) OVER x AS w2, lead(w0, 3) OVER x AS w3 FROM flat WINDOW x AS (PARTITION BY p ORDER BY i)),
occurrences AS (
  SELECT lang, 1 AS m, w0 AS phrase FROM led UNION ALL
  SELECT lang, 2, w0 || ' ' || w1 FROM led WHERE w1 IS NOT NULL UNION ALL
  SELECT lang, 3, w0 || ' ' || w1 || ' ' || w2 FROM led WHERE w2 IS NOT NULL UNION ALL
  SELECT lang, 4, w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM led WHERE w3 IS NOT NULL
), counted AS (SELECT lang, phrase, m, count(*) AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS part1, array_to_string(w[k + 1:], ' ') AS part2 FROM cuts),
scored AS (
  SELECT p.lang, p.phrase, p.a, x.f AS l, y.f AS r, CAST(2000000 * CAST(p.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, k
  FROM parts p JOIN counted x ON x.lang = p.lang AND x.phrase = p.part1 JOIN counted y ON y.lang = p.lang AND y.phrase = p.part2
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (
  SELECT lang, a, unnest(list_transform(range(0, m - s + 1), lambda i: array_to_string(w[i + 1:i + s], ' '))) AS phrase
  FROM candidates, (VALUES (2), (3)) AS t(s) WHERE s < m
), covered AS (SELECT lang, phrase, max(a) AS most FROM spans GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered c USING (lang, phrase) WHERE c.most IS NULL OR 100 * CAST(c.most AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
