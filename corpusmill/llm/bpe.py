"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes its documents in blocks. A block's distinct words that it hasn't met (matches of the pattern) are laid
out as one sequence of byte symbols, and an inverted index maps each mergeable token pair, by its rank, to the
positions where it stands. The merges are replayed once for all these words together, in rank order: a merge is applied
to all its positions at once, and only the pairs with their two neighbours are looked up anew. Ids of a word are kept
for later blocks, up to a bound, so frequent words are merged once a task. Words don't influence each other, so blocks
give the same ids as the corpus at once, and nothing is shuffled.

Decoding is the reverse lookup: the bytes of a row's ids, joined.

Defined cases: a null text is an empty one (no ids); texts of any length are taken whole (a text of over STRETCH
characters is matched in stretches, without being held as words all at once); an id outside the vocabulary fails; an
empty table gives an empty result; other columns pass through, except that columns named ids or decoded are replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import release, table

#: Characters of text whose words are laid out together.
BLOCK = 2_000_000
#: Words whose ids a task keeps.
WORDS = 300_000
#: Matches of one text that are held at once.
STRETCH = 1_000_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The ranks of a .tiktoken file, and the token pairs that they merge."""

    def __init__(self, lines: bytes, pattern: str):
        self.split = regex.compile(pattern)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.tokens = {rank: token for token, rank in ranks.items()}
        size = max(self.tokens, default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.known = lengths > 0
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p] for p in self.pairs.tolist()] + [NONE], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens; NONE if there is none (or right is no token, -1)."""
        code = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pairs, code)
        at[at == len(self.pairs)] = 0
        hit = (right >= 0) & (self.pairs[at] == code) if len(self.pairs) else np.zeros(len(code), bool)
        return np.where(hit, self.ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, joined, and the count of each word's."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if n and symbols.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        last = np.cumsum(lengths) - 1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        own = lengths > 0
        after[last[own]] = -1
        before[(last - lengths + 1)[own]] = -1
        pad = np.r_[symbols, np.int32(-1)]  # position -1 reads as no token
        rank = self.rank(pad[:-1], pad[after])
        # the inverted index: rank -> positions of the pair's left token
        order = np.argsort(rank, kind="stable").astype(np.int32)
        order = order[: np.searchsorted(rank[order], NONE)]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        index = {int(rank[part[0]]): [part] for part in np.split(order, cuts) if len(part)}
        todo = list(index)
        heapq.heapify(todo)
        rank = np.r_[rank, NONE]
        while todo:
            r = heapq.heappop(todo)
            places = index.pop(r, None)
            if places is None:
                continue
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (rank[right] == r).any():  # such as a a a: from left to right, without overlap
                keep, gone = [], set()
                for i, j in zip(at.tolist(), right.tolist()):
                    if i not in gone:
                        keep.append(i)
                        gone.add(j)
                at = np.array(keep, np.int32)
                right = after[at]
            nxt, prv = after[right], before[at]
            pad[at] = r
            pad[right] = -1
            rank[right] = NONE
            after[at] = nxt
            before[nxt[nxt >= 0]] = at[nxt >= 0]
            # only the pairs with the two neighbours have changed; of two merged neighbours, the later wins
            touched = np.r_[at, prv[prv >= 0]]
            new = self.rank(pad[touched], pad[after[touched]])
            rank[touched] = new
            live = new != NONE
            if live.any():
                touched, new = touched[live], new[live]
                if len(new) < 8:
                    groups = [(int(k), touched[i : i + 1]) for i, k in enumerate(new)]
                else:
                    by = np.argsort(new, kind="stable")
                    touched, new = touched[by], new[by]
                    cuts = np.flatnonzero(np.diff(new)) + 1
                    groups = [(int(new[i]), part) for i, part in zip(np.r_[0, cuts], np.split(touched, cuts))]
                for k, part in groups:
                    if k in index:
                        index[k].append(part)
                    else:
                        index[k] = [part]
                        heapq.heappush(todo, k)
        alive = np.flatnonzero(pad[:-1] >= 0)
        counts = np.bincount(np.repeat(np.arange(len(words)), lengths)[alive], minlength=len(words))
        return pad[alive], counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of the ranges, joined."""
    total = np.cumsum(counts)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if n < 2**31 and (not len(starts) or starts.max() < 2**31 - n) else np.int64
    return np.repeat((starts - (total - counts)).astype(kind), counts) + np.arange(n, dtype=kind)


def slices(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to about `most`; a larger row stands alone."""
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Encoder:
    """Encodes texts with one vocabulary, remembering words between blocks."""

    def __init__(self, vocabulary: Vocabulary, words: int = WORDS):
        self.v, self.most = vocabulary, words
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}
        self.starts, self.counts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def learn(self, words: set[str]):
        if not words:
            return
        new = list(words)
        ids, counts = self.v.replay([w.encode() for w in new])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.counts, self.ids = np.r_[self.counts, counts], np.r_[self.ids, ids]

    def _ids(self, stretches: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.most:
            self.forget()
        known = self.number
        self.learn(set().union(*stretches) - known.keys())
        n = sum(map(len, stretches))
        word = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(stretches)), np.int64, n)
        counts = self.counts[word]
        ends = np.r_[0, np.cumsum(counts)][np.cumsum([0, *map(len, stretches)])]
        return self.ids[spread(self.starts[word], counts)], np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, joined, and the count of each text's."""
        out, counts, held, size = [], [], [], 0

        def close():
            nonlocal held, size
            if held:
                ids, n = self._ids(held)
                out.append(ids)
                counts.append(n)
            held, size = [], 0

        for t in texts:
            if len(t) > STRETCH:
                close()
                found, n = (m.group() for m in self.v.split.finditer(t)), 0
                while part := list(itertools.islice(found, STRETCH // 4)):
                    ids, k = self._ids([part])
                    out.append(ids)
                    n += int(k[0])
                counts.append(np.array([n]))
                continue
            held.append(self.v.split.findall(t))
            size += len(t)
            if size > BLOCK:
                close()
        close()
        return np.concatenate([np.empty(0, np.int32), *out]), np.concatenate([np.empty(0, np.int64), *counts])


@functools.lru_cache(2)
def _encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(lines, pattern))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(batches, encoder: Encoder, at: int, names: list[str]):
    """Batches with the ids of the text in column `at`, in slices of about BLOCK bytes."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy()
        for lo, hi in slices(sizes, BLOCK):
            b = whole.slice(lo, hi - lo)
            ids, counts = encoder.encode([x or "" for x in b.column(at).to_pylist()])
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(ids))], names=names)
    release()


def _decoded(batches, v: Vocabulary, at: int, names: list[str]):
    """Batches with the bytes of the ids in column `at`, in slices of about BLOCK / 4 ids."""
    for whole in batches:
        each = whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in slices(each, BLOCK // 4):
            b = whole.slice(lo, hi - lo)
            col, parts = b.column(at), []
            flat = col.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(v.known) or not v.known[flat].all()):
                raise ValueError("an id is outside the vocabulary")
            lengths = (v.starts[flat + 1] - v.starts[flat]).astype(np.int32)
            for i in range(0, len(flat), BLOCK // 4):  # a long row is one slice, but isn't decoded at once
                some = flat[i : i + BLOCK // 4]
                parts.append(v.bytes[spread(v.starts[some], lengths[i : i + BLOCK // 4])])
            ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)][np.r_[0, np.cumsum(each[lo:hi])]]
            data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
            done = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            if col.null_count:
                done = pc.if_else(col.is_valid(), done, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, done], names=names)


IDS, DECODED = StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids: the token ids of text. ranks: what a .tiktoken file holds (a vocabulary, about 1 MB)."""
    docs = docs.drop("ids")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(ranks), docs.columns.index(text), [*docs.columns, "ids"]
    return docs.mapInArrow(lambda batches: _encoded(batches, _encoder(shared.value, pattern), at, names), StructType([*docs.schema, IDS]))


def decode(rows: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded: the bytes of the token ids (null ids: null)."""
    rows = rows.drop("decoded")
    shared, at, names = rows.sparkSession.sparkContext.broadcast(ranks), rows.columns.index(ids), [*rows.columns, "decoded"]
    return rows.mapInArrow(lambda batches: _decoded(batches, _encoder(shared.value, pattern).v, at, names), StructType([*rows.schema, DECODED]))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """docs without text, with ids and decoded: encode and decode in one pass, so that a task has one Python worker."""
    docs = docs.drop("ids", "decoded")
    at, keep = docs.columns.index(text), [c for c in docs.columns if c != text]
    shared, names = docs.sparkSession.sparkContext.broadcast(ranks), [*docs.columns, "ids"]

    def run(batches):
        encoder = _encoder(shared.value, pattern)
        ids = (b.select([*keep, "ids"]) for b in _encoded(batches, encoder, at, names))
        return _decoded(ids, encoder.v, len(keep), [*keep, "ids", "decoded"])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), IDS, DECODED]))


def op6_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
