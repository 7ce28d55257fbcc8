"""Importing this module registers the queries of every operator."""

from __future__ import annotations

from tabula.llm import bpe_chunks, filter_audit, fingerprint, language_id, mixing, ngram_join, packing, quality, suffix_dedup, token_alignment, token_counts, toxicity, url_filter  # noqa: F401
from tabula.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
