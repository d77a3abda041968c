"""Prompts for judges, as column expressions: one criterion each, with the answers that it allows.

The wording is this library's own. Inputs are a task's question, claim or claims, answer and evidence; evidence is an array
of struct(label, citation, text).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import _c

RULES = (
    "Act as a judge of evidence; do not answer the question yourself. Rely on the passages below and on nothing else.\n"
    "Current passages decide what is to be done; earlier ones only explain. That something was not found does not show that "
    "it does not exist. What is merely plausible is not supported.\n"
    "Reply with one JSON object of the given schema."
)
CRITERIA = {
    "claim_support": (
        "Is every part of the claim stated by the passages? SUPPORTED: every part. PARTIALLY_SUPPORTED: a part is, another is "
        "not. UNSUPPORTED: it is not stated. CONTRADICTED: a passage states the opposite. Only SUPPORTED passes."
    ),
    "citation_entailment": "Does one of the cited passages alone state the whole claim? YES or NO; a shared topic is NO.",
    "overreach": "Does the answer state any condition, exclusion, threshold, cause or advice that no passage states? YES or NO; name the claims.",
    "completeness": "Does the answer hold what a safe reply to the question needs from the passages, and say what is missing? YES or NO.",
    "refusal_quality": "The question is outside the scope. Does the reply say so, without advice and without claiming that no guidance exists? YES or NO.",
}


def evidence_text(evidence) -> Column:
    """Passages in order, each under its label and citation; a fixed line where there is none."""
    blocks = F.transform(_c(evidence), lambda e: F.concat(e["label"], F.lit(" | "), e["citation"], F.lit("\n"), e["text"]))
    return F.when(F.size(F.coalesce(_c(evidence), F.array())) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit("No passage was cited."))


def claim_list(claims) -> Column:
    """Claims (array of struct claim_id, claim) as lines."""
    lines = F.transform(_c(claims), lambda c: F.concat(c["claim_id"], F.lit(": "), c["claim"]))
    return F.when(F.size(F.coalesce(_c(claims), F.array())) > 0, F.array_join(lines, "\n")).otherwise(F.lit("No claim was made."))


def _prompt(criterion: str, *parts) -> Column:
    head = F.lit(f"{RULES}\n\nCriterion {criterion}: {CRITERIA[criterion]}")
    return F.concat(head, *[x for title, body in parts for x in (F.lit(f"\n\n{title}:\n"), F.coalesce(body, F.lit("")))])


def claim_support(question="question", claim="claim", evidence="evidence") -> Column:
    return _prompt("claim_support", ("Question", _c(question)), ("Claim", _c(claim)), ("Passages", evidence_text(evidence)))


def citation_entailment(claim="claim", cited="cited") -> Column:
    return _prompt("citation_entailment", ("Claim", _c(claim)), ("Cited passages", evidence_text(cited)))


def overreach(question="question", answer="answer", claims="claims", evidence="evidence") -> Column:
    return _prompt("overreach", ("Question", _c(question)), ("Answer", _c(answer)), ("Claims", claim_list(claims)), ("Passages", evidence_text(evidence)))


def completeness(question="question", answer="answer", expected="expected", evidence="evidence") -> Column:
    return _prompt("completeness", ("Expected behaviour", _c(expected)), ("Question", _c(question)), ("Answer", _c(answer)), ("Passages", evidence_text(evidence)))


def refusal_quality(question="question", answer="answer") -> Column:
    return _prompt("refusal_quality", ("Question", _c(question)), ("Reply", _c(answer)))


def schema(criterion: str) -> str:
    """The JSON schema of a judgment."""
    labels = V.SUPPORT_LABELS if criterion == "claim_support" else V.YES_NO
    properties = {"label": {"type": "string", "enum": labels}, "reason": {"type": "string"}}
    if criterion == "overreach":
        properties["claim_ids"] = {"type": "array", "items": {"type": "string"}}
    return json.dumps({"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False})
