"""Folds over sorted streams: what a row gets from those before it, where no window and no prefix scan can say it.

A partition's rows come to one task, are sorted there by Spark (which spills) and pass in Arrow batches. Only the fold's state
is held from row to row and from batch to batch: nothing is gathered in a cell or a group, and the time is linear.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..store import fresh


def folded(rows: DataFrame, partition: list[str], order: list, reads: list[str], adds: str, start: Callable[[], Callable]) -> DataFrame:
    """rows with the columns `adds` (DDL), which a fold gives each row from its `reads` and what it keeps of earlier rows.

    start() makes the step of one partition; a step takes the values of `reads` and returns those of `adds`, as a tuple.
    partition: columns of exact types (a null is a value like others); order: columns or sort expressions.
    """
    made = StructType.fromDDL(adds)
    types = [field.type for field in to_arrow_schema(made)]
    names = [*rows.columns, *made.names]

    def run(batches):
        now, step = object(), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in partition)))
            out = []
            for key, *values in zip(keys, *(batch.column(c).to_pylist() for c in reads)):
                if key != now:
                    now, step = key, start()
                out.append(step(*values))
            new = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(new, types))], names=names)

    dealt = rows.repartition(*partition).sortWithinPartitions(*partition, *order)
    return dealt.mapInArrow(run, StructType([*rows.schema, *made]))


def parents(toc: DataFrame, document: str = "document", order: str = "ord") -> DataFrame:
    """Adds parents: the open titles of smaller level above each entry, outermost first. Other columns: order, level, title.

    A stack of open entries, no deeper than levels are nested. An entry without a level closes all that are open and is
    nobody's parent; entries of one order follow each other by level, then title.
    """

    def start():
        open_ = []

        def step(level, title):
            while open_ and (level is None or open_[-1][0] >= level):
                open_.pop()
            above = [t for _, t in open_]
            if level is not None:
                open_.append((level, title))
            return (above,)

        return step

    rows = toc.select(document, F.col(order).cast("bigint").alias(order), F.col("level").cast("int").alias("level"), "title")
    return folded(rows, [document], [order, "level", "title"], ["level", "title"], "parents array<string>", start)


def section_ends(toc: DataFrame, last_page: int, document: str = "document", order: str = "ord") -> DataFrame:
    """Adds page_end: the page before the next entry of the same or a smaller level, else the last page.

    From the last entry to the first, a stack keeps the next entry of each smaller level (the nearest smaller value).
    Entries of one order don't end each other; one without order or level ends none and is ended by none.
    """
    after = fresh(toc.columns, "_after")

    def start():
        nearest, before = [], [None, None, None]

        def step(at, level, page):
            if at is None or level is None:
                return (None,)
            if before[:2] != [at, level]:
                # larger levels of an order come first, so none of its own entries is found
                while nearest and nearest[-1][0] > level:
                    nearest.pop()
                before[:] = at, level, nearest[-1][1] if nearest else None
                if nearest and nearest[-1][0] == level:
                    nearest.pop()
                nearest.append((level, page))
            return (before[2],)

        return step

    rows = toc.select(document, order, "level", "title", "page")
    kind = toc.schema["page"].dataType.simpleString()
    out = folded(rows, [document], [F.desc(order), F.desc("level"), "page"], [order, "level", "page"], f"{after} {kind}", start)
    return out.select(*rows.columns, F.coalesce(F.col(after) - 1, F.lit(last_page)).alias("page_end"))


def word_lines(words: DataFrame, page: list[str], tolerance: float = 2.0) -> DataFrame:
    """page, line (from 0) and text of words (top, x0, text) grouped to lines, each line's words by x0.

    A word within tolerance of the first word of the line above joins it. A word without a top is a line of its own.
    """
    line = fresh(words.columns, "line")

    def start():
        head, number = None, -1

        def step(top):
            nonlocal head, number
            if head is None or top is None or not abs(head - top) <= tolerance:
                head, number = top, number + 1
            return (number,)

        return step

    rows = words.select(*page, F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text")
    lines = folded(rows, page, ["top", "x0", "text"], ["top"], f"{line} int", start).groupBy(*page, line)
    inner = F.array_sort(F.collect_list(F.struct("x0", "text")))  # one line's words
    return lines.agg(F.array_join(inner["text"], " ").alias("text")).withColumnRenamed(line, "line")


def records(lines: DataFrame, section: list[str], order: list[str], begins: Column, mark: str, opens: str, closes: str, least: int) -> DataFrame:
    """section, ordinal (from 1), page, page_end, text of the records that a section's lines (page, text) form.

    A record begins at a line where `begins` holds and ends with the line that completes `mark`, a pattern, in its text
    joined by blanks. `opens` matches the end of a line that begins a mark, `closes` the start of one that ends it; blank lines
    may stand between. A gap of more than a page, or a line without a page, drops what is open; a record that is open at the
    section's end stays if it has `least` characters. Patterns are matched once a line, by Spark; the fold sees flags.
    """
    text, named = F.coalesce(F.col("text"), F.lit("")), ["_begins", "_ends", "_opens", "_closes", "_blank"]
    flags = dict(zip(named, [F.coalesce(begins, F.lit(False)), text.rlike(mark), text.rlike(opens), text.rlike(closes), text.rlike(r"^\s*\z")]))

    def start():
        live, half, last, record, done = False, False, None, 0, 0

        def step(page, begins, ends, opens, closes, blank):
            nonlocal live, half, last, record, done
            live = live and page is not None and last is not None and page <= last + 1
            last = page
            if not live:
                half = False
                if not begins:
                    return None, None, None
                live, record = True, record + 1
            over = ends or (half and closes)
            out = record, done + 1, over
            if over:
                live, done = False, done + 1
            half = opens or (half and blank)
            return out

        return step

    rows = lines.select(*section, *order, "page", "text", *(c.alias(n) for n, c in flags.items()))
    held = folded(rows, section, order, ["page", *named], "_record long, _ordinal long, _over boolean", start).where("_record is not null")
    at = F.struct(*order)
    out = held.groupBy(*section, "_record", "_ordinal").agg(
        F.min_by("page", at).alias("page"), F.max_by("page", at).alias("page_end"), F.max("_over").alias("_over"), F.max(at).alias("_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ").alias("text"),  # one record's lines
    )
    last = lines.groupBy(*(F.col(c).alias(f"_of_{c}") for c in section)).agg(F.max(at).alias("_end"))
    on = F.lit(True)
    for c in section:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = out.join(last, on).where(F.col("_over") | ((F.col("_at") == F.col("_end")) & (F.length("text") >= least)))
    return out.select(*section, F.col("_ordinal").alias("ordinal"), "page", "page_end", "text")
