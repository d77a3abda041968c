"""Ordered operators: segments, carried markers, ranges, prefixes and latest rows. All windows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import fresh, stash
from .index import bounded


def _dealt(rows: DataFrame, partition: list[str], order: list, name: str) -> tuple[DataFrame, str]:
    """rows dealt by ranges of (partition, order), in order within each task, stored; and the column that names the task."""
    id_, task = (fresh(rows.columns, x) for x in ("_id", "_task"))
    dealt = rows.repartitionByRange(*partition, *order).sortWithinPartitions(*partition, *order).withColumn(id_, F.monotonically_increasing_id())
    return stash(dealt.withColumn(task, F.shiftright(id_, 33)).drop(id_), name), task


def _with_earlier(dealt: DataFrame, per: DataFrame, partition: list[str], task: str) -> DataFrame:
    """dealt with what per (a row a partition and task) has for each row's partition and task."""
    own = per.withColumnsRenamed({c: f"_of_{c}" for c in [*partition, task]})
    on = F.col(task) == F.col(f"_of_{task}")
    for c in partition:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(bounded(own), on).drop(*(f"_of_{c}" for c in [*partition, task]))


def segments(rows: DataFrame, partition: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds segment: how many rows of the partition have started one, up to this row.

    A prefix scan: rows are dealt by ranges of (partition, order), so a large partition spans many tasks; each task sums its
    own, and a table with a row a partition and task says what came before.
    """
    mark, before = fresh(rows.columns, "_starts"), fresh(rows.columns, "_before")
    dealt, task = _dealt(rows.withColumn(mark, starts.cast("long")), partition, order, "segments")
    earlier = Window.partitionBy(*partition).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*partition, task).agg(F.sum(mark).alias(before))
    per = per.withColumn(before, F.sum(before).over(earlier))
    own = Window.partitionBy(*partition, task).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here, came = F.sum(mark).over(own), F.col(before)
    # null until a row has said whether it starts one
    total = F.when(here.isNull() & came.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0)))
    return _with_earlier(dealt, per, partition, task).withColumn("segment", total).select(*rows.columns, "segment")


def carried(rows: DataFrame, partition: list[str], order: list[str], value: Column, name: str, default=None) -> DataFrame:
    """Adds `name`: the last non-null value strictly before each row, or the default. A prefix scan, as segments."""
    held, before = fresh(rows.columns, "_held"), fresh(rows.columns, "_before")
    dealt, task = _dealt(rows.withColumn(held, value), partition, order, "carried")
    earlier = Window.partitionBy(*partition).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(held).isNotNull(), F.struct(*order, F.col(held).alias("_last"))))
    per = dealt.groupBy(*partition, task).agg(last["_last"].alias(before))
    per = per.withColumn(before, F.last(before, ignorenulls=True).over(earlier))
    own = Window.partitionBy(*partition, task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = F.coalesce(F.last(held, ignorenulls=True).over(own), F.col(before), *([] if default is None else [F.lit(default)]))
    kept = [c for c in rows.columns if c != name]
    return _with_earlier(dealt, per, partition, task).withColumn(name, out).select(*kept, name)


#: The level of intervals without an end, which all rows are held against.
ENDLESS = 10_000


def within(rows: DataFrame, value: str, intervals: DataFrame, low: str, high: str, block: int = 100_000) -> DataFrame:
    """Rows with each interval that holds their value (numbers; both ends count).

    An interval lies in two or three bins of the least power of two that is no shorter, and a value in one bin of each
    power in use, so the two meet by an equi-join on power and bin. Powers and not intervals multiply the rows. Up to `block`
    pieces of intervals go to all tasks; more are met by a shuffle.
    """
    level, bin_ = (fresh([*rows.columns, *intervals.columns], x) for x in ("_level", "_bin"))
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    width, ends = hi - lo, (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))
    power = F.when(ends & (width > 0), F.ceil(F.log2(width)).cast("int")).when(ends, F.lit(0)).otherwise(F.lit(ENDLESS))
    place = lambda x: F.when(F.col(level) == ENDLESS, 0.0).otherwise(x / F.pow(F.lit(2.0), F.col(level)))
    cut = intervals.where(F.col(low) <= F.col(high)).withColumn(level, power)
    powers = sorted(r[0] for r in cut.select(level).distinct().collect())  # the exponents of doubles at most
    steps = F.sequence(F.lit(0), (F.floor(place(hi)) - F.floor(place(lo))).cast("int"))
    cut = cut.withColumn(bin_, F.explode(F.transform(steps, lambda i: F.floor(place(lo)).cast("double") + i)))
    each = rows.where(F.col(value).isNotNull()).withColumn(level, F.explode(F.array(*map(F.lit, powers)).cast("array<int>")))
    each = each.withColumn(bin_, F.floor(place(F.col(value).cast("double"))).cast("double"))
    return each.join(bounded(cut, block), [level, bin_]).where(F.col(value).between(F.col(low), F.col(high))).drop(level, bin_)


def by_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows with each prefix that their text begins with: an equi-join on the beginnings of each length that a prefix has."""
    start = fresh([*rows.columns, *prefixes.columns], "_start")
    lengths = sorted(r[0] for r in prefixes.where(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect())
    cuts = F.array(*(F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths)).cast("array<string>")
    each = rows.withColumn(start, F.explode(cuts)).where(F.col(start).isNotNull())
    return each.join(bounded(prefixes), F.col(start) == F.col(prefix)).drop(start)


def latest(rows: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The k latest rows of each partition, with recency from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)


def numbered(rows: DataFrame, partition: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds `name`: the row's number in its partition, in order. No partition needs to fit a task, as in a window.

    Rows are dealt by ranges of (partition, order), so that a large partition spans many tasks; a task numbers its own rows,
    and a table with a row a partition and task says how many come before. order: columns; null is first.
    """
    keys = [fresh(rows.columns, x) for x in ("_id", "_task", "_least", "_most", "_before")]
    id_, task, least, most, before = keys
    dealt = rows.repartitionByRange(*partition, *order).sortWithinPartitions(*partition, *order).withColumn(id_, F.monotonically_increasing_id())
    dealt = stash(dealt.withColumn(task, F.shiftright(id_, 33)), "numbered")
    per = dealt.groupBy(*partition, task).agg(F.min(id_).alias(least), F.max(id_).alias(most))
    earlier = Window.partitionBy(*partition).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(before, F.coalesce(F.sum(F.col(most) - F.col(least) + 1).over(earlier), F.lit(0))).drop(most)
    own = per.withColumnsRenamed({c: f"_of_{c}" for c in [*partition, task]})
    on = F.col(task) == F.col(f"_of_{task}")
    for c in partition:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = dealt.join(bounded(own), on).withColumn(name, F.col(id_) - F.col(least) + 1 + F.col(before))
    return out.select(*rows.columns, name)


def at_ranks(rows: DataFrame, partition: list[str], value: str, ranks: dict) -> DataFrame:
    """partition and, for each name of ranks, the value at the rank that it gives for n (a column: the rows with a value)."""
    some = rows.where(F.col(value).isNotNull()).select(*partition, value)
    ordered = numbered(some, partition, [value], "_number")
    n = some.groupBy(*partition).agg(F.count("*").alias("_n"))  # a row a partition
    ordered = ordered.join(bounded(n), partition)
    picked = [F.max(F.when(F.col("_number") == rank(F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return ordered.groupBy(*partition).agg(*picked)


def seen_before(rows: DataFrame, unit: list[str], order: str) -> DataFrame:
    """Adds seen: the unit stood in a row of smaller `order` (a unique key).

    The first row of each unit comes from a partial aggregate and is joined back, so a unit that many rows repeat is a
    hot key of a join, which AQE splits, rather than one task's window. Units are told apart by digest.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in unit])), 256)
    rows = rows.withColumn("_unit", digest)
    first = rows.groupBy("_unit").agg(F.min(order).alias("_first"))
    return rows.join(first, "_unit").withColumn("seen", F.col(order) > F.col("_first")).drop("_unit", "_first")


def before_marker(lines: Column, pattern: str) -> Column:
    """The lines before the first that matches."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)


def between_anchors(lines: Column, start: str, end: str) -> Column:
    """The lines from the first that matches start up to the first later one that matches end; null if either is missing."""
    a = F.array_position(F.transform(lines, lambda x: x.rlike(start)), F.lit(True)).cast("int")
    rest = F.when(a > 0, F.slice(lines, a, F.size(lines)))
    b = F.array_position(F.transform(rest, lambda x: x.rlike(end)), F.lit(True)).cast("int")
    return F.when(b > 0, F.slice(rest, F.lit(1), b - 1))
