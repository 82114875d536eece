"""Queries and oracle SQL of all operators of this subpackage."""

from __future__ import annotations

from langmix.llm import (bpe, decontaminate, fptree, jaccard, langid, merkle, pii, quality, sharding, substring, topk, toxicity,
                         warc)

MODULES = (langid, jaccard, substring, sharding, quality, bpe, topk, toxicity, warc, decontaminate, pii, fptree, merkle)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
