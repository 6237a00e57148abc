"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q
from . import sql

PLAIN = (
    q.tokenize_terms, q.corpus_stats, q.term_idf, q.bm25_topk, q.bm25_zero_fill, q.dense_topk, q.dense_filtered_topk, q.dense_native_scores,
    q.rrf_fuse, q.rerank_cache_miss, q.hashed_embedding_topk, q.entity_parse, q.where_eval, q.section_scan, q.section_extract, q.section_best,
    q.section_warnings, q.html_to_text, q.html_parsed, q.filing_rollup, q.chunk_recursive, q.chunk_section_aware, q.chunk_invariants, q.chunk_counts,
    q.amounts_match, q.refusal_flags, q.citations, q.context_prompt, q.generated_answers, q.hit_at_k, q.eval_matrix, q.eval_summary, q.eval_by_type,
    q.eval_slice, q.eval_rescore, q.latency_percentiles, q.filing_index, q.latest_per_year, q.manifest_grid, q.manifest_missing, q.page_overlap,
    q.point_lookup, q.excerpt_view, q.chunk_pipeline_topk,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in PLAIN} | q.RETRIEVALS


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
