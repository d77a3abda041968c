"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(V.TOKEN), F.lit(0))


def joined(sep: str, *parts) -> Column:
    """Parts joined, without nulls and empty strings."""
    return F.concat_ws(sep, *[F.nullif(_c(p), F.lit("")) for p in parts])


def retrieval_text(section, subsection, recommendation_id, sites, content_type, text) -> Column:
    """The indexed text of a chunk: its metadata on a line of its own, then its text."""
    return F.concat(joined(" ", section, subsection, recommendation_id, F.array_join(_c(sites), " "), content_type), F.lit("\n"), _c(text))


def table_text(features, cancers, action) -> Column:
    """The text of a row of a symptom table, in three lines."""
    return F.concat(F.lit("Symptom and specific features: "), _c(features), F.lit("\nPossible cancer: "), _c(cancers), F.lit("\nActions: "), _c(action))


def citation(title, section, recommendation_id, page, page_end, version) -> Column:
    page, end = _c(page), _c(page_end)
    pages = F.when(end.isNotNull() & (end != 0) & (end != page), F.concat(page.cast("string"), F.lit("–"), end.cast("string"))).otherwise(page.cast("string"))
    rec = F.when(F.nullif(_c(recommendation_id), F.lit("")).isNotNull(), F.concat(F.lit("Recommendation "), _c(recommendation_id)))
    return F.concat_ws(" · ", F.lit(title), _c(section), rec, F.concat(F.lit("Page "), pages), _c(version))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def squeeze(text) -> Column:
    """Runs of Unicode white space become a space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def heading(text) -> Column:
    return squeeze(F.translate(_c(text), "‑–", "--"))


def repair_glue(text) -> Column:
    out = _c(text)
    for bad, good in V.GLUE.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(out, "[ \t]+", " "))


def preview(text, most: int) -> Column:
    """Texts of over `most` characters are cut to three less and end in three dots."""
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most - 3), F.lit("..."))).otherwise(_c(text))


def dotted_key(value) -> Column:
    """Numbers of a dotted id, which order as arrays do."""
    return F.transform(F.split(_c(value), "[.]"), lambda x: x.cast("int"))


def sites(text) -> Column:
    """Sites that a text mentions, in the fixed order; "gall bladder" is no bladder."""
    low = F.replace(F.lower(heading(text)), F.lit("gall bladder"), F.lit(""))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(s)) for s, p in V.SITE_MENTIONS.items()]))


def content_type(section_type, term, recommendation_id) -> Column:
    rid = _c(recommendation_id)
    return (
        F.when(_c(section_type) == "symptom_table", "symptom_table")
        .when(F.nullif(_c(term), F.lit("")).isNotNull(), "definition")
        .when(rid.startswith("1.15."), "safety_netting")
        .when(rid.startswith("1.14."), "patient_support")
        .when(rid.startswith("1.16."), "diagnostic_process")
        .when(F.nullif(rid, F.lit("")).isNotNull(), "recommendation")
        .otherwise("guidance")
    )


#: Where a sentence ends: white space after a full stop, question or exclamation mark, before one of these.
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9•])"
CLAIM_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9*])"


def sentences(text, pattern: str = SENTENCE) -> Column:
    return F.filter(F.transform(F.split(_c(text), pattern), lambda s: F.trim(s)), lambda s: s != "")


def logical_units(text, table=None) -> Column:
    """Lines of a table; else bullets whole and other lines by sentence; the text itself if that leaves none."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    cut = F.flatten(F.transform(lines, lambda x: F.when(x.startswith("•") | x.startswith("-"), F.array(x)).otherwise(sentences(x))))
    units = cut if table is None else F.when(_c(table), lines).otherwise(cut)
    return F.when(F.size(units) > 0, units).otherwise(F.array(_c(text)))


def packed(sizes, target: int = 550, most: int = 700) -> Column:
    """array of struct(start, n): units packed in order to chunks. A chunk is closed before it would pass `most`, or once it
    has `target`; a separator counts 1.

    sizes: the units' token counts. The fold holds numbers only, and grows its array by one where a chunk ends.
    """
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("held"), F.lit(0).alias("at"))

    def step(a, s):
        over = (a["held"] > 0) & (a["n"] + 1 + s > most)
        n = F.when(over | (a["held"] == 0), s).otherwise(a["n"] + 1 + s)
        closed = F.when(over, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"])
        return F.struct(
            F.when(n >= target, F.concat(closed, F.array(a["at"] + 1))).otherwise(closed).alias("ends"),
            F.when(n >= target, 0).otherwise(n).alias("n"),
            F.when(n >= target, 0).when(over, 1).otherwise(a["held"] + 1).alias("held"),
            (a["at"] + 1).alias("at"),
        )

    last = lambda a: F.when(a["held"] > 0, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"])
    ends = F.aggregate(F.transform(_c(sizes), lambda s: s.cast("int")), start, step, last)
    pairs = lambda e: F.arrays_zip(F.concat(F.array(F.lit(0)), e).alias("start"), e.alias("stop"))
    whole = F.transform(F.array(ends), lambda e: F.filter(pairs(e), lambda p: p["stop"].isNotNull()))  # names ends, made once
    return F.transform(F.element_at(whole, 1), lambda p: F.struct(p["start"].alias("start"), (p["stop"] - p["start"]).alias("n")))


def pack(units, sizes, target: int = 550, most: int = 700) -> Column:
    """The chunks' texts, units joined by line breaks. Units above `most` are to be cut by `cut_long` before."""
    return F.transform(packed(sizes, target, most), lambda p: F.array_join(F.slice(_c(units), p["start"] + 1, p["n"]), "\n"))


def cut_long(units, target: int = 550, most: int = 700) -> Column:
    """Units of over `most` tokens cut in slices of `target` tokens (joined by spaces), others as they are."""

    def cut(u, t):
        starts = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), F.lit(target))
        return F.when(F.size(t) > most, F.transform(starts, lambda i: F.array_join(F.slice(t, i, target), " "))).otherwise(F.array(u))

    # the inner transform names the unit's tokens, so that they are made once
    return F.flatten(F.flatten(F.transform(_c(units), lambda u: F.transform(F.array(tokens(u)), lambda t: cut(u, t)))))


def join_wrapped(text) -> Column:
    """Wrapped lines joined to paragraphs: a blank line ends one, a bullet starts one, a final hyphen joins without a space.

    What goes before a line follows from it and the line before, so lines are joined in one pass.
    """
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))

    def joined_(own):
        before = F.concat(F.array(F.lit("")), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))))
        rows = F.filter(F.arrays_zip(own.alias("x"), before.alias("b")), lambda z: z["x"] != "")
        new = lambda z: (z["b"] == "") | z["x"].startswith("•") | z["x"].startswith("-")
        lead = lambda z: F.when(new(z), "\n").when(z["b"].endswith("-"), "").otherwise(" ")
        return F.array_join(F.transform(rows, lambda z: F.concat(lead(z), z["x"])), "")

    return F.regexp_replace(F.element_at(F.transform(F.array(lines), joined_), 1), "^\n", "")  # names lines, made once


def clean_page(text, page, header: str, footer: str, footer_inside: str) -> Column:
    """struct(text, headers_removed, footer_lines_removed): a page without its furniture.

    header: a line removed on pages after the first; footer: a pattern that begins the footer, which lasts to the page's
    end; footer_inside: a pattern of single footer lines. Runs of blank lines become one, none at the end.
    """
    raw = F.split(F.regexp_replace(_c(text), "\r\n|\r", "\n"), "\n")
    lines = F.transform(raw, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), "[ \t]+", " "))
    body = F.filter(lines, lambda x: ~((_c(page) > 1) & (x == header)))
    first = F.array_position(F.transform(body, lambda x: x.rlike(footer)), F.lit(True)).cast("int")
    kept = F.when(first > 0, F.slice(body, F.lit(1), first - 1)).otherwise(body)
    tail = F.when(first > 0, F.slice(body, first, F.size(body))).otherwise(F.array().cast("array<string>"))
    single = F.filter(kept, lambda x: x.rlike(footer_inside))
    plain = F.transform(F.filter(kept, lambda x: ~x.rlike(footer_inside)), lambda x: F.regexp_replace(x, "^－", "-"))
    out = F.regexp_replace(F.regexp_replace(F.array_join(plain, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    return F.struct(
        out.alias("text"),
        (F.size(lines) - F.size(body)).alias("headers_removed"),
        (F.size(F.filter(tail, lambda x: x != "")) + F.size(single)).alias("footer_lines_removed"),
    )


def match_form(text) -> Column:
    """The form in which two versions of a text are compared."""
    low = F.translate(F.lower(_c(text)), "–‑", "--")
    for p in (V.TWO_WEEKS, V.YEAR, V.LONG_ID):
        low = F.regexp_replace(low, p, "")
    return F.array_join(F.regexp_extract_all(low, F.lit(V.MATCH_TOKEN), F.lit(0)), " ")


def match_terms(text) -> Column:
    terms = F.array_distinct(F.split(match_form(text), " "))
    return F.array_except(terms, F.array(*map(F.lit, [*V.MATCH_STOPWORDS, ""])))


def jaccard(left, right) -> Column:
    both, any_ = F.size(F.array_intersect(_c(left), _c(right))), F.size(F.array_union(_c(left), _c(right)))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def clinical_numbers(text) -> Column:
    out = _c(text)
    for p in (V.TWO_WEEKS, V.YEAR, V.LONG_ID):
        out = F.regexp_replace(out, p, "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(out, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))))


def actions(text) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(_c(text).rlike(p), F.lit(a)) for a, p in V.ACTIONS.items()])))


def tri_state(value) -> Column:
    """True, false, or null for what doesn't apply; fails on anything else."""
    v = F.lower(F.trim(_c(value)))
    return (
        F.when(v.isin(V.TRUE_WORDS), F.lit(True))
        .when(v.isin(V.FALSE_WORDS), F.lit(False))
        .when(v.isin(V.NA_WORDS), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("neither true, false nor not applicable: "), F.coalesce(v, F.lit("null")))).cast("boolean"))
    )
