"""Queries of the subpackage, one for each operator, and SQL where it can express one."""

from __future__ import annotations

from tessera.llm import bpe, langid, minhash, mixing, pii, quality_rules, secrets, suffix, vectors, weak_quality

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_mix_sources": mixing.query,
    "op3_suffix_dedup": suffix.query,
    "op4_language_id": langid.query,
    "op5_quality_rules": quality_rules.query,
    "op6_bpe": bpe.query,
    "op7_minhash_dedup": minhash.query,
    "op8_quality_classifier": weak_quality.query,
    "op9_pii": pii.query,
    "op10_embedding_dedup": vectors.query,
}
ORACLE_SQL = {"op2_mix_sources": mixing.SQL}
