"""Registered queries of the text-corpus operators with their SQL counterparts."""

from __future__ import annotations

from bayline.llm import backoff_query, bpe_query, collocations_query, decontamination_query, importance_query, jaccard_query, language_query, media_query, mixing_query, rules_query, secrets_query, shards_query, topk_query

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (media_query, shards_query, mixing_query, topk_query, rules_query, bpe_query, secrets_query, language_query, backoff_query, jaccard_query, collocations_query, importance_query, decontamination_query):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
