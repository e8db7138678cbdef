"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from marketlens.llm import jaccard, lines, merkle, mixing, nearcopies, neighbours, periods, pieces, quality, secrets, sql, suffixes, tokens, toxicity

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_jaccard": jaccard.query,
    "op3_toxicity": toxicity.query,
    "op4_quality": quality.query,
    "op5_mixing": mixing.query,
    "op6_suffixes": suffixes.query,
    "op7_neighbours": neighbours.query,
    "op8_lines": lines.query,
    "op9_sentencepiece": pieces.query,
    "op10_nearcopies": nearcopies.query,
    "op11_periods": periods.query,
    "op12_merkle": merkle.query,
    "op13_tokens": tokens.query,
}

ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
