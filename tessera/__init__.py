"""A Spark-native engine for searching and evaluating windowed text, and for preparing training text.

The search side: functions (Columns over text), operators (retrieval, ranking, evaluation, diagnostics, windowing,
governance), sources (files and releases), plans (search and the registered queries), streaming and plugins. The
names below are its public interface; they are loaded when first used, so a worker imports only what it runs.
"""

from __future__ import annotations

import importlib

_PUBLIC = {
    "tessera.operators.evaluation": "compare_methods metric_summary query_metrics relevance",
    "tessera.operators.governance": "benchmark_problems contract corpus_contract frozen identity_sides missing_and_extra pool_contract prerequisite_problems verify_inventory",
    "tessera.operators.ranking": "aggregate_videos candidate_pool capped_pool final_order pareto_frontier supporting_windows",
    "tessera.operators.retrieval": "bm25 dense_scores dense_top dual_tfidf legacy_scores rrf tfidf_cosine weighted_fusion",
    "tessera.operators.summaries": "aggregation_summary dual_summary failure_review method_summary rerank_metrics target_results target_summary",
    "tessera.operators.windowing": "consecutive_duplicates physical_windows processed",
    "tessera.plans.search": "Engine SearchConfig",
    "tessera.sources.release": "Release activate active build_release load_release validate_release",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
