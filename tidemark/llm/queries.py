"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from tidemark.llm import bpe, chat, decontam, fingerprint, langid, neardup, pii, quality, toxicity, warc

QUERIES = {
    "op1_langid": langid.query,
    "op2_decontam": decontam.query,
    "op3_chat": chat.query,
    "op4_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_neardup": neardup.query,
    "op7_warc": warc.query,
    "op8_bpe": bpe.query,
    "op9_quality": quality.query,
    "op10_fingerprint": fingerprint.query,
}

ORACLE_SQL: dict[str, str] = {}
