"""The queries of the training-data operators, by name, with their SQL where there is one."""

from __future__ import annotations

from dupscan.llm import q_bpe, q_embeddings, q_html, q_lattice, q_licenses, q_mixing, q_passages, q_quality, q_simhash, q_toxicity

_MODULES = (q_simhash, q_toxicity, q_mixing, q_bpe, q_lattice, q_quality, q_embeddings, q_passages, q_licenses, q_html)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
