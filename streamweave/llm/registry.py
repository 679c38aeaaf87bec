"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from streamweave.llm.conversations import op12_conversation_repair
from streamweave.llm.conversations import oracle as conversation_sql
from streamweave.llm.decontamination import op7_benchmark_decontamination
from streamweave.llm.fingerprints import op9_document_fingerprints
from streamweave.llm.html_text import op3_html_main_text
from streamweave.llm.language import op5_language_id
from streamweave.llm.metric_trees import op11_centroid_clustering
from streamweave.llm.metric_trees import oracle as clustering_sql
from streamweave.llm.packing import op2_best_fit_packing
from streamweave.llm.pii import op8_pii_spans
from streamweave.llm.quality import op6_quality_classifier
from streamweave.llm.secrets import op13_secret_scan
from streamweave.llm.sharding import op10_hilbert_shards
from streamweave.llm.simhash import op4_simhash_near_dedup
from streamweave.llm.tokens import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_main_text": op3_html_main_text,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii_spans": op8_pii_spans,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op11_centroid_clustering": clustering_sql(), "op12_conversation_repair": conversation_sql()}
