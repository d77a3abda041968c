"""Question guards as column expressions, and the outcome that they give in order."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V
from .text import _c, squeeze


def _named(text, patterns) -> Column:
    pairs = patterns.items() if isinstance(patterns, dict) else patterns
    return F.array_compact(F.array(*[F.when(_c(text).rlike(p), F.lit(name)) for name, p in pairs]))


def emergency_reasons(text) -> Column:
    return _named(text, V.EMERGENCIES)


def emergency(text) -> Column:
    """True for explicit, current, high-acuity scenarios only."""
    reasons = emergency_reasons(text)
    acute = F.arrays_overlap(reasons, F.array(*map(F.lit, V.ACUTE)))
    return (F.size(reasons) > 0) & _c(text).rlike(V.IMMEDIATE) & (_c(text).rlike(V.SEVERE) | acute)


def excluded_sites(text) -> Column:
    return _named(text, {s: f"(?i){p}" for s, p in V.EXCLUDED_SITES.items()})


def selected_sites(text) -> Column:
    """Sites in scope named outside all mentions of excluded sites."""
    out = _c(text)
    for p in V.EXCLUDED_SITES.values():
        out = F.regexp_replace(out, f"(?i){p}", " ")
    return _named(out, {s: f"(?i){p}" for s, p in V.SELECTED_SITES.items()})


def out_of_scope(text) -> Column:
    return (F.size(excluded_sites(text)) > 0) & (F.size(selected_sites(text)) == 0)


def clinical_features(text, code: str = "") -> Column:
    """Sorted distinct tokens that may name a feature. code: the guideline's own code, which names none."""
    plain = F.array(*map(F.lit, [*V.PLAIN_WORDS, *V.SITE_WORDS, *([code] if code else [])]))
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(V.QUESTION_TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 1) & ~t.rlike(f"^(?:{V.AGE})$"))
    return F.array_sort(F.array_except(F.array_distinct(kept), plain))


def insufficient(text, code: str = "") -> Column:
    """A decision or a patient is asked about, and no feature named."""
    return (F.size(clinical_features(text, code)) == 0) & (_c(text).rlike(V.DECISION_INTENT) | _c(text).rlike(V.PATIENT_CONTEXT))


@F.pandas_udf(StringType())
def safety_form(text: pd.Series) -> pd.Series:
    """Compatibility form without format characters, case-folded, white space squeezed (no built-in does NFKC)."""

    def form(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
        return " ".join(t.casefold().split())

    return text.map(form)


def control_reasons(form) -> Column:
    """Reasons to block an instruction, of a text in its safety form; in order, each once."""
    compact = F.regexp_replace(_c(form), "[^a-z0-9]+", "")
    found = [F.when(_c(form).rlike(f"(?isu){p}"), F.lit(r)) for r, p in V.CONTROL_PATTERNS]
    found += [F.when(F.contains(compact, F.lit(s)), F.lit(r)) for r, s in V.COMPACT_SIGNATURES]
    return F.array_distinct(F.array_compact(F.array(*found)))


def intent_types(query_tokens) -> Column:
    """Content types that a question explicitly asks for: a rationale before evidence; else none."""
    some = lambda words: F.arrays_overlap(_c(query_tokens), F.array(*map(F.lit, words)))
    return F.when(some(V.RATIONALE_INTENT), F.array(F.lit("rationale"))).when(some(V.EVIDENCE_INTENT), F.array(F.lit("evidence"), F.lit("evidence_table"))).otherwise(F.array().cast("array<string>"))


def canonical_question(text) -> Column:
    return squeeze(text)


def outcome(text, blocked=None, code: str = "") -> Column:
    """The guards in order: the first that applies decides. Without it, the question goes to retrieval (null)."""
    out = F.when(blocked, "safety_refusal") if blocked is not None else F
    out = out.when(emergency(text), "emergency_redirect").when(out_of_scope(text), "scope_refusal")
    return out.when(insufficient(text, code), "insufficient_information")
