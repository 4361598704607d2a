"""Operators of a training-data pipeline; each module registers its query and SQL."""

from evidquarry.llm import (
    bpe, chat_format, decontamination, hard_negatives, jaccard_join, language_id, near_dedup, pii, ranked_search, sharding, token_counts, topk_search, warc,
)

MODULES = (
    decontamination, topk_search, pii, sharding, token_counts, near_dedup, language_id, warc, chat_format, bpe, jaccard_join, hard_negatives, ranked_search,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
