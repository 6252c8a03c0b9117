"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from tsfoundry.llm import (
    bpe, exact_dedup, language, merkle, near_dedup, packing, quality, sharding, spelling, suffix_dedup, token_counts, toxicity, url_filter,
)

_MODULES = [bpe, exact_dedup, language, merkle, near_dedup, packing, quality, sharding, spelling, suffix_dedup, token_counts, toxicity, url_filter]

QUERIES = {m.NAME: m.query for m in _MODULES} | {"pipeline": corpus_pipeline.run}
ORACLES = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
