"""Queries and SQL of this subpackage: one ``opN_<name>`` per operator."""

from __future__ import annotations

from . import bpe, chat, fingerprints, jaccard_join, mixing, quality_rules, secrets, sstable, url_filters, warc

QUERIES = {
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op1_mixing": mixing.op1_mixing,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_sstable": sstable.op5_sstable,
    "op6_bpe": bpe.op6_bpe,
    "op7_warc": warc.op7_warc,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
}
ORACLES = {**mixing.ORACLE, **quality_rules.ORACLE, **url_filters.ORACLE, **warc.ORACLE, **jaccard_join.ORACLE}
