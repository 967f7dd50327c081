"""All queries of this folder."""

from __future__ import annotations

from sieveguard.llm import (  # noqa: F401
    sharding, url_filter, mixing, simhash, language_id,
    decontamination, embedding_dedup,
    token_store, token_counts, html_extraction, source_audit,
    ranked_search, personal_data)
from sieveguard.llm.registry import ORACLES, QUERIES  # noqa: F401
