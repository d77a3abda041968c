"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ..session import shipped
from . import ann, bpe, langid, licenses, mixing, phrases, quality, rules, runs, simhash, toxicity, warc, word_bpe


def queries() -> dict:
    own = {
        "op1_mixing": mixing.op1_mixing,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op4_ann": ann.op4_ann,
        "op5_licenses": licenses.op5_licenses,
        "op6_bpe": bpe.op6_bpe,
        "op7_langid": langid.op7_langid,
        "op8_warc": warc.op8_warc,
        "op9_rules": rules.op9_rules,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_runs": runs.op11_runs,
        "op12_phrases": phrases.op12_phrases,
        "op13_word_bpe": word_bpe.op13_word_bpe,
    }
    return {name: shipped(q) for name, q in own.items()}


def oracle_sql() -> dict:
    return {"op1_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE, "op12_phrases": phrases.ORACLE}
