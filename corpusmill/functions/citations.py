"""Citation labels in answers: canonical form, claim units and validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import CLAIM_SENTENCE, _c

# The shapes that a label may have. _S is white space with zero-width characters.
_S = r"[\s\u200b\u200c\u200d\u2060\ufeff]*"
_LABEL = rf"\*{{0,2}}{_S}E{_S}\d+{_S}\*{{0,2}}"
_GROUP = re.compile(rf"[\[【(]{_S}(?:Evidence{_S})?{_LABEL}(?:{_S}[;,/]{_S}{_LABEL})*{_S}[\]】)]", re.I)
_LINES = re.compile(rf"[【\[]{_S}E{_S}(\d+){_S}†{_S}L\d+(?:{_S}-{_S}L?\d+)?{_S}[】\]]", re.I)
_ALONE = re.compile(rf"(?<![\w\[])\*{{0,2}}E{_S}(\d+)\*{{0,2}}(?={_S}[–—:-])", re.I)
_NUMBER = re.compile(rf"E{_S}(\d+)", re.I)
CITATION = r"\[E(\d+)\]"
WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
SEPARATOR = r"^\|?[\s:|-]+\|?$"
HEADING = r"^(?:#{1,6}\s+|\*\*[^*]+\*\*\s*$)"


def canonical(answer: str | None) -> str | None:
    if answer is None:
        return None
    one = lambda m: f"[E{int(m.group(1))}]"
    answer = _ALONE.sub(one, _LINES.sub(one, answer))
    return _GROUP.sub(lambda m: " ".join(f"[E{int(n)}]" for n in _NUMBER.findall(m.group(0))), answer)


@F.pandas_udf(StringType())
def canonical_labels(answer: pd.Series) -> pd.Series:
    """Labels in the one form [En]. A group's labels become several, which no built-in replacement does."""
    return answer.map(canonical)


def claim_units(answer) -> Column:
    """Sentences, list items and table rows of four words or more; headings, table heads and separators are none."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(_c(answer), "\r\n|\r|\n"), strip), lambda x: x != "")
    zipped = F.arrays_zip(lines.alias("x"), F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(""))).alias("nxt"))
    kept = F.filter(zipped, lambda z: ~z["nxt"].rlike(SEPARATOR) & ~z["x"].rlike(SEPARATOR) & ~z["x"].rlike(HEADING))
    body = lambda x: strip(F.regexp_replace(x, r"^(?:[-*+]\s+|\d+[.)]\s+)", ""))
    units = F.flatten(F.transform(kept, lambda z: F.when(z["x"].startswith("|") & z["x"].endswith("|"), F.array(z["x"])).otherwise(F.transform(F.split(body(z["x"]), CLAIM_SENTENCE), strip))))
    return F.filter(units, lambda u: F.size(F.regexp_extract_all(F.regexp_replace(u, CITATION, ""), F.lit(WORD), F.lit(0))) >= 4)


def labels(answer) -> Column:
    return F.transform(F.regexp_extract_all(_c(answer), F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def validation(answer, available) -> Column:
    """struct(valid, invalid, units, cited, coverage, labels_ok, coverage_ok, passed) of a canonical answer."""
    all_ = F.array_sort(F.array_distinct(labels(answer)))
    ok = lambda x: (x >= 1) & (x <= _c(available))
    units = claim_units(answer)
    cited = F.size(F.filter(units, lambda u: u.rlike(CITATION)))
    good, bad, n = F.filter(all_, ok), F.filter(all_, lambda x: ~ok(x)), F.size(units)
    labels_ok, coverage_ok = (F.size(good) > 0) & (F.size(bad) == 0), (n > 0) & (cited == n)
    return F.struct(
        good.alias("valid"), bad.alias("invalid"), n.alias("units"), cited.alias("cited"), F.when(n > 0, F.round(cited / n, 4)).otherwise(0.0).alias("coverage"),
        labels_ok.alias("labels_ok"), coverage_ok.alias("coverage_ok"), (labels_ok & coverage_ok).alias("passed"),
    )


def split_claims(answer) -> Column:
    """array of struct(claim_id, text, ranks); empty pieces are dropped but numbered."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.transform(F.split(_c(answer), CLAIM_SENTENCE), lambda s, i: F.struct(F.concat(F.lit("C"), i + 1).alias("claim_id"), strip(s).alias("s")))
    return F.transform(
        F.filter(parts, lambda p: p["s"] != ""),
        lambda p: F.struct(p["claim_id"].alias("claim_id"), strip(F.regexp_replace(p["s"], CITATION, "")).alias("text"), labels(p["s"]).alias("ranks")),
    )


def answer_outcome(checked, refused=None) -> Column:
    """A refusal, a grounded answer, or one that is withheld."""
    passed = F.when(_c(checked)["passed"], "grounded_answer").otherwise("generation_rejected")
    return passed if refused is None else F.coalesce(refused, passed)
