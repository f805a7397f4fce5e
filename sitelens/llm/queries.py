"""The queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from . import audio, chat, decontam, divergence, infill, jaccard, licenses, packing, passages, pii, rollup, toxicity, warc

MODULES = [packing, chat, audio, decontam, rollup, toxicity, pii, jaccard, warc, passages, infill, divergence, licenses]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
