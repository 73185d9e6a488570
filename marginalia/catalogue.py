"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from marginalia.plans import aggregate_queries, catalog_queries, check_queries, context_queries, evidence_queries, grid_queries, join_queries, layout_queries, order_queries, package_queries, retrieval_queries, scalar_queries, storage_queries, text_queries, understanding_queries  # noqa: F401  each registers its queries
from marginalia.plans.registry import ORACLE_SQL as _SQL, QUERIES

#: Columns whose types the other engine would make wider or decimal: a rank is an int here, a sum a long.
_INTS = {
    "table_bases": "place", "fold_sections": "page", "chunk_greedy_pack": "n_chunks longest", "replace_sections": "ord", "pending_queue_ttl": "place", "top_rows_by_column": "row_idx place",
    "cross_table_facts": "tables", "trend_outliers": "year", "checks_report": "place", "calc_candidates": "place", "rows_and_chars_limits": "total_rows",
    "left_join_nulls_first": "place", "mentions_theta": "n", "nearest_caption": "pos caption_pos", "ordered_merge": "place", "full_outer_lists": "sem_rank lex_rank", "coverage_round_robin": "rank place",
    "context_coverage": "rank", "batch_tasks": "place", "list_user_documents": "place", "bm25_topk": "place", "bm25_indexed": "place", "like_topk": "place", "verbatim_hits": "piece_no at", "cosine_topk": "place",
    "cosine_boosted": "place", "retrieve_thresholds": "place", "hybrid_merge": "place", "label_suggest": "distance place", "split_and_fold_cells": "n", "sample_context": "n groups",
}
_OTHERS = {"conditional_counts": {"chars": "BIGINT"}, "chunk_greedy_pack": {"chars": "BIGINT"}, "percent_sanity": {"sum": "DOUBLE"}, "like_topk": {"score": "DOUBLE"}}


def _typed(name: str, sql: str) -> str:
    casts = dict.fromkeys(_INTS.get(name, "").split(), "INTEGER") | _OTHERS.get(name, {})
    if not casts:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in casts.items()) + f") FROM ({sql}) AS typed"


ORACLE_SQL = {name: _typed(name, sql) for name, sql in _SQL.items()}

__all__ = ["ORACLE_SQL", "QUERIES"]
