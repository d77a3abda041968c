"""SimHash near-duplicate components, found with sharded BK-trees.

1. Each text's 64-bit fingerprint: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of its word
   shingles, repeats included.
2. Equal fingerprints become one row (a partial aggregate, so a hot group of copies costs a row a task).
3. Shards. Cut 64 bits into k blocks: two fingerprints within radius r differ in at most r blocks, so at least k - r
   agree. Each fingerprint goes to a shard for every choice of k - r blocks (15 for k = 6, r = 4); any two within the
   radius meet in one at least. A shard's BK-tree (children keyed by their integer distance to the parent) is searched
   with the shard's own members, following only edges within the radius. The trees are dealt to the tasks with their
   queries rather than broadcast whole: all trees together grow with the corpus, so no bound for a broadcast exists.
4. A shard of more than `most` members isn't held: its members go on to finer shards, over the bits that they don't
   share yet. Members share all bits of their key, so with f free bits a shard has 2^f at most: this ends, and is exact.
   Shards that a sample of the fingerprints shows to be crowded are cut so before they are shuffled, in all tasks; one
   that the sample misses passes through its task without being held, and is cut in the next round.
5. A shard's members go down its tree together, each along the edges within the radius of its distance to the node. The
   shard yields a spanning forest of its links (fewer rows than members), never all pairs; components follow from the
   forests by large-star/small-star rounds, and documents get theirs by their fingerprint.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than
a shingle is one shingle; documents of a null id get the least id of their component, or null if it has none; rows
with the same id are each fingerprinted (`near_dedup` tells them apart by their text's hash, and keeps one of rows with
equal id and text); an empty table gives an empty result; other columns pass by (the query) or
through (`near_dedup`).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, scratch, sieved, stash, table
from .components import connected_components

#: Shard members that a task holds at once.
MOST = 2_000
#: Blocks that the 64 bits are cut into: 15 shards a fingerprint for a radius of 4, each over 21 bits or more.
BLOCKS = 6
STEP = 1 << 16
#: One fingerprint in so many is looked at to find crowded shards, of which so many are named to all tasks at most.
LOOK, CROWDED = 64, 200_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of UTF-8 text; bytes.split() cuts at exactly the six ASCII white-space bytes."""
    w = text.lower().split()  # bytes.lower() changes A-Z only
    if not w:
        return 0
    if len(w) < words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(itertools.islice(w, i, None) for i in range(words)))), len(w) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    while (h := np.fromiter((digest(s, seed) for s in itertools.islice(shingles, STEP)), np.uint64)).size:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """The columns of docs but text, and fp: the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    fields = [docs.schema[c] for c in rest]

    def run(batches):
        for b in batches:
            texts = b.column(len(rest))
            fps = np.fromiter((fingerprint(x.as_py(), words, seed) if x.is_valid else 0 for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*fields, StructField("fp", LongType())])
    return docs.select(*rest, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


class BKTree:
    """A BK-tree of distinct fingerprints: each member is a node, its children keyed by their integer distance to it.

    A subtree's node is its least member. `order` lists the members so that a subtree's stand together.
    """

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        self.fps, self.kids = fps, [()] * n
        self.order, self.at, self.size = (np.empty(n, np.int32) for _ in range(3))
        todo, place = [np.arange(n, dtype=np.int32)] if n else [], 0
        while todo:
            m = todo.pop()
            node, others = int(m[0]), m[1:]
            self.order[place], self.at[node], self.size[node], place = node, place, len(m), place + 1
            if len(others):
                d = np.bitwise_count(fps[others] ^ fps[node])
                by = np.argsort(d, kind="stable")
                parts = np.split(by, np.flatnonzero(np.diff(d[by])) + 1)
                self.kids[node] = [(int(d[part[0]]), int(others[part[0]])) for part in parts]
                todo += [others[part] for part in parts]

    def below(self, node: int) -> np.ndarray:
        """The members of a subtree."""
        return self.order[self.at[node] : self.at[node] + self.size[node]]


def forest(fps: np.ndarray, radius: int, block: int = 512):
    """Edges (i, j) that connect what links within the radius connect: one fewer than a component has members.

    Blocks of members go down from the tree's root together; an edge is followed only by those whose distance to its node is
    within the radius of the edge's, and by none where they and the whole subtree are one component already. What waits
    refers to its parent's block, so a deep tree holds one block a level.
    """
    n = len(fps)
    tree, root, groups, a, b = BKTree(fps), np.arange(n, dtype=np.int32), {}, [], []

    def join(i: int, near: np.ndarray):
        found, first = np.unique(root[near], return_index=True)
        for r, j in zip(found.tolist(), near[first].tolist()):
            own = int(root[i])
            a.append(i)
            b.append(j)
            x, y = groups.pop(own, [own]), groups.pop(r, [r])
            if len(x) < len(y):
                x, y, own = y, x, r
            root[y] = own
            x += y
            groups[own] = x

    for lo in range(1, n, block):
        q = np.arange(lo, min(lo + block, n), dtype=np.int32)
        todo = [(0, q, np.zeros(len(q), np.int16), 0)]
        while todo:
            node, q, d, edge = todo.pop()
            q = q[(np.abs(d - edge) <= radius) & (q > node)]  # members before a node are before all of its subtree
            if not len(q):
                continue
            apart = root[q] != root[node]
            if not apart.any() and (root[tree.below(node)] == root[node]).all():
                continue
            d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int16)
            near = q[(d <= radius) & apart]
            if len(near):
                join(node, near)
            todo += [(child, q, d, edge) for edge, child in tree.kids[node]]
    return a, b


def _cut(free: int, blocks: int):
    """Widths of the blocks that free bits are cut into."""
    return [free // blocks + (i < free % blocks) for i in range(blocks)]


def _level(rows: DataFrame, blocks: int, radius: int, most: int) -> DataFrame:
    """rows: fp, mask (bits that the members of its shard share). One round of shards over the other bits.

    Returns a, b (links) or fp, mask (members of shards that are too large, for the next round).
    """

    # a mask has few values; the bits of each block are worked out once for each of them
    def keys(mask: int):
        spare = [i for i in range(64) if not mask >> i & 1]
        k = min(blocks, len(spare))
        parts, at = [], 0
        for width in _cut(len(spare), k):
            parts.append(sum(1 << i for i in spare[at : at + width]))
            at += width
        take = max(k - radius, 0)
        if take == 0:
            return [mask]
        return [mask | sum(c) for c in itertools.combinations(parts, take)]

    def able(key: int) -> bool:
        """Whether a shard could hold more than `most` members at all."""
        return 2 ** (64 - key.bit_count()) > most

    def deal(batches, crowded: dict[int, np.ndarray], want: bool):
        """mask, value, fp of the shards that are crowded (want) or aren't."""
        for b in batches:
            fp, mask = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            for m in np.unique(mask):
                own = fp[mask == m]
                for key in keys(int(m)):
                    values = own & np.uint64(key)
                    some = crowded.get(key)
                    hit = np.isin(values, some) if some is not None else np.zeros(len(own), bool)
                    if (take := hit == want).any():
                        u = np.full(int(take.sum()), key, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, values[take], own[take])], names=["mask", "value", "fp"])

    def shards(batches):
        """Rows come sorted by mask and value; a shard is held up to `most` members, and passed on beyond."""
        held: list = []
        now, n, over = None, 0, False

        def out(a=(), b=(), fp=(), mask=()):
            a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
            fp, mask = np.asarray(fp, np.uint64), np.asarray(mask, np.uint64)
            none, fill = pa.nulls(len(a), pa.int64()), pa.nulls(len(fp), pa.int64())
            cols = [(a, fill), (b, fill), (none, fp), (none, mask)]
            arrays = [pa.concat_arrays([pa.array(x.view(np.int64)) if isinstance(x, np.ndarray) else x for x in c]) for c in cols]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "fp", "mask"])

        def close():
            if n > 1 and not over:
                fps = np.concatenate(held)
                i, j = forest(fps, radius)
                if i:
                    yield out(fps[i], fps[j])

        for batch in batches:
            mask, value, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
            inner = slice(1, len(starts) - 1)
            several = np.flatnonzero(ends[inner] - starts[inner] > 1) + 1  # shards of one inside the batch hold no link
            for s in sorted({0, len(starts) - 1, *several.tolist()}):
                lo, hi = starts[s], ends[s]
                if (mask[lo], value[lo]) != now:
                    yield from close()
                    now, n, over, held = (mask[lo], value[lo]), 0, False, []
                held.append(fp[lo:hi])
                n += hi - lo
                if over or n > most:
                    over = True
                    own = np.concatenate(held)
                    held = []
                    yield out(fp=own, mask=np.full(len(own), now[0], np.uint64))
        yield from close()

    schema, rows = "mask long, value long, fp long", rows.select("fp", "mask")
    crowded: dict[int, np.ndarray] = {}
    if rows.count() > most:
        some = rows.where(F.pmod(F.xxhash64("fp", "mask"), F.lit(LOOK)) == 0).mapInArrow(lambda b: deal(b, {}, False), schema)
        some = some.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") >= max(most / LOOK / 2, 2))
        for r in some.limit(CROWDED).collect():
            if able(r.mask % 2**64):
                crowded.setdefault(r.mask % 2**64, []).append(r.value % 2**64)
        crowded = {k: np.array(sorted(v), np.uint64) for k, v in crowded.items()}
    dealt = rows.mapInArrow(lambda b: deal(b, crowded, False), schema)
    dealt = dealt.repartition("mask", "value").sortWithinPartitions("mask", "value")
    out = dealt.mapInArrow(shards, "a long, b long, fp long, mask long")
    if not crowded:
        return out
    none = F.lit(None).cast("long")
    passed = rows.mapInArrow(lambda b: deal(b, crowded, True), schema)
    return out.unionAll(passed.select(none.alias("a"), none.alias("b"), "fp", "mask"))


def links(fps: DataFrame, radius: int = 4, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """a, b: fingerprints (distinct, column fp) within radius; not every pair, but all connections."""
    # a shard with f free bits holds 2^f members at most, so it is never passed on
    most = max(most, 2 ** (radius + 2))
    todo, found = fps.select("fp", F.lit(0).cast("long").alias("mask")), None
    for _ in range(1 + math.ceil(64 / 2)):
        step = stash(_level(todo, blocks, radius, most), "simhash-links")
        own = step.where("a is not null").select("a", "b")
        found = own if found is None else found.unionAll(own)
        todo = step.where("fp is not null").select("fp", "mask")
        if not todo.limit(1).count():
            break
        todo = stash(todo.distinct(), "simhash-finer")
    return found


def components(prints: DataFrame, key: str = "doc_id", radius: int = 4, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """fp, root, component_id for every distinct fp of prints (key, fp); root names the component by a fingerprint."""
    distinct = stash(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    with scratch(prints.sparkSession, "simhash"):
        member = stash(connected_components(links(distinct, radius, blocks, most)), "simhash-members", outer=True).withColumnRenamed("node", "fp")
    named = member.join(distinct, "fp")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    alone = distinct.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return stash(named.unionAll(alone), "simhash-components")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each component: its least id (nulls last), of equal ids the text of least hash.

    Documents alone in their component, and those kept that aren't repeated, pass in a scan; others, and what a filter of a
    fixed size takes for them, are joined to the verdicts.
    """
    hashed = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    prints = stash(with_fingerprint(hashed, "text", words), "simhash-prints")
    rooted = prints.join(components(prints, "_id", radius).select("fp", "root"), "fp")
    name = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")
    best = stash(rooted.groupBy("root").agg(F.min(name).alias("best"), F.count("*").alias("n")).where("n > 1"), "simhash-best")
    each = rooted.join(best, "root").groupBy("_id", "_hash").agg(F.max(name != F.col("best")).alias("lost"), F.count("*").alias("n"))
    named = stash(each.where("lost or n > 1").select("_id", "_hash", "lost"), "simhash-named")
    alone, rest = sieved(docs, F.xxhash64(key, F.xxhash64(text)), named, F.xxhash64("_id", "_hash"))
    hash_ = fresh(docs.columns, "__hash")
    rest, lost = rest.withColumn(hash_, F.xxhash64(text)), bounded(named.where("lost"))
    rest = rest.join(lost, F.col(key).eqNullSafe(lost["_id"]) & (F.col(hash_) == lost["_hash"]), "left_anti")
    if named.where("not lost").limit(1).count():
        rest = rest.dropDuplicates([key, hash_])
    return alone.unionAll(rest.drop(hash_))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stash(with_fingerprint(docs), "simhash-prints")
    out = prints.join(components(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
