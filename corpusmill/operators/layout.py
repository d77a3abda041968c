"""Laid-out lines to records: predicates on geometry and fonts, modes carried between lines, and records cut from them.

lines: document, section, page, y, x, text, size, fonts (array), ord. Modes and records are folds over a section's lines,
the unit that a record never leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..store import fresh
from . import folds

#: Words that begin a recommendation, marks that end it, and lines that set a mode.
ACTION_START = (
    r"(?i)^(?:Refer|Offer|Consider|For people|Discuss|Explain|Give|The information|Provide|Reassure|When referring|If the person|"
    r"Ensure|Take part|Discussion|Put in place|Include|Use local|Once the decision|Healthcare professionals|Advise)\b"
)
UPDATE_MARKER = r"(?i)\[(?:(?:new|amended)\s+)?(?:19|20)\d{2}\]"
#: A mark's first and second half, where a line ends within it.
MARKER_HALVES = r"(?i)\[(?:new|amended)\s*\z", r"^\s*(?:19|20)\d{2}\]"
TABLE_TITLE = r"(?i)^Table\s+\d+[:.)]"
RATIONALE = ["Relative value placed on the", "Quality of the evidence", "Trade-off between clinical", "Trade-off between net health"]
#: Least characters of a trailing record, and of any other.
TRAILING, LEAST = 80, 40


def furniture(y, x, height) -> Column:
    """Header, footer and sidebar lines."""
    return (F.col(y) < 52) | (F.col(y) > F.col(height) - 52) | (F.col(x) > 525)


def boxed(x="x", size="size", fonts="fonts") -> Column:
    """Bold lines of the right column, in the size of boxed recommendations."""
    return (F.col(x) >= 250) & F.col(size).between(9.0, 10.6) & F.exists(fonts, lambda f: f.contains("Bold"))


def semibold(words) -> Column:
    """The semi-bold words of a line (array of struct text, font), joined."""
    return F.array_join(F.transform(F.filter(words, lambda w: w["font"].contains("SemiBold")), lambda w: w["text"]), " ")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One line of each page, rounded place and text: the first in order."""
    keys = ["document", "page", F.bround("y", 0).alias("ry"), F.bround("x", 0).alias("rx"), "text"]
    first = lines.groupBy(*keys).agg(F.min("ord").alias("ord"))
    return lines.join(first.select("document", "ord"), ["document", "ord"], "left_semi")


def mode_of(text="text") -> Column:
    """The mode that a line sets, null for lines that set none."""
    t = F.col(text)
    out = F.when(t.startswith("Clinical question"), "clinical_question").when(t.isin("Clinical evidence", "Evidence statement", "Evidence statements", "Cost-effectiveness evidence"), "evidence")
    out = out.when(t.rlike(TABLE_TITLE), "evidence_table")
    for r in RATIONALE:
        out = out.when(t.startswith(r), "rationale")
    return out


def modes(lines: DataFrame, first: str = "clinical_context") -> DataFrame:
    """Adds mode (carried from the line that set it), and record: lines of a record share it.

    A record ends where a mode is set, and, for tables and rationales, at the page's end. Lines from "References" on are left
    out. One fold over a section's lines in order; lines of one order follow each other by page, then text.
    """

    def start():
        gone, mode, record, last = False, first, 0, None

        def step(ends, sets, page):
            nonlocal gone, mode, record, last
            gone = gone or bool(ends)
            if gone:
                return None, None
            turned = last is not None and page is not None and page != last and mode in ("evidence_table", "rationale")
            mode, record, last = sets or mode, record + (sets is not None or turned), page
            return mode, record

        return step

    sets, ends = (fresh(lines.columns, x) for x in ("_sets", "_ends"))
    marked = lines.withColumns({sets: mode_of(), ends: F.col("text") == "References"})
    kept = [c for c in lines.columns if c not in ("mode", "record")]
    marked = marked.select(*kept, sets, ends)
    out = folds.folded(marked, ["document", "section"], ["ord", "page", "text"], [ends, sets, "page"], "mode string, record long", start)
    return out.where("record is not null").drop(sets, ends)


def split_at_update(text) -> Column:
    """A line cut after its update mark, if anything follows it."""
    t = F.col(text) if isinstance(text, str) else text
    mark = F.regexp_extract(t, UPDATE_MARKER, 0)
    at = F.when(mark != "", F.position(mark, t) + F.length(mark) - 1)
    rest = F.trim(F.substring(t, at + 1, F.length(t)))
    return F.when((mark != "") & (rest != ""), F.array(F.trim(F.substring(t, F.lit(1), at)), rest)).otherwise(F.array(t))


def recommendations(lines: DataFrame, section: list[str], order: list[str]) -> DataFrame:
    """section, ordinal, page, page_end, text: records of a section's boxed lines, split at update marks (`folds.records`).

    A record starts with an action and ends with an update mark; a gap of a page drops what is open; an open one at the end
    stays if it is long enough.
    """
    return folds.records(lines, section, order, F.col("text").rlike(ACTION_START), UPDATE_MARKER, *MARKER_HALVES, TRAILING)


def page_sections(lines: DataFrame, default: str = "Untitled") -> DataFrame:
    """document, page, title, text: a page's title is its first large, short, bold line."""
    bold = F.exists("fonts", lambda f: f.contains("Bold")) & (F.col("size") >= 11) & (F.size(F.split(F.trim("text"), r"\s+")) <= 14)
    out = lines.groupBy("document", "page").agg(
        F.min_by(F.when(bold, F.col("text")), F.when(bold, F.col("ord"))).alias("title"),
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"),  # one page's lines
    )
    return out.select("document", "page", F.coalesce("title", F.lit(default)).alias("title"), F.array_join(F.col("l.text"), "\n").alias("text"))


def nearest_parent(parents) -> Column:
    """The innermost numbered title among the parents."""
    return F.try_element_at(F.filter(parents, lambda p: p.rlike(r"^1\.\d+\s")), F.lit(-1))


def table_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows of symptom tables that are whole (three cells, none missing) and whose second cell names a site in scope.

    Adds sites and text, the row's three lines; rows that don't fit are left out (`row_problem` says why).
    """
    out = rows.where(row_problem(cells).isNull()).withColumn("sites", T.sites(T.repair_glue(F.col(cells)[1])))
    part = lambda i: T.repair_glue(F.col(cells)[i])
    return out.where(F.size("sites") > 0).withColumn("text", T.table_text(part(0), part(1), part(2)))


def row_problem(cells="cells") -> Column:
    """malformed for a row that hasn't three cells or misses one; else null."""
    return F.when(F.coalesce((F.size(cells) != 3) | F.exists(cells, lambda c: c.isNull()), F.lit(True)), "malformed")
