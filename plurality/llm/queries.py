"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from plurality.llm.centroids import op11_centroid_clustering
from plurality.llm.chunk_bpe import op2_chunk_bpe
from plurality.llm.fingerprints import op1_fingerprints
from plurality.llm.jaccard_join import op6_jaccard_join
from plurality.llm.lexical_search import op12_ranked_search
from plurality.llm.license_scan import op8_license_scan
from plurality.llm.oracle import ORACLE
from plurality.llm.packing import op9_best_fit_packing
from plurality.llm.quality_model import op4_quality_model
from plurality.llm.quality_rules import op3_quality_rules
from plurality.llm.substring_dedup import op10_substring_dedup
from plurality.llm.token_files import op7_token_files
from plurality.llm.vector_neighbours import op13_vector_neighbours
from plurality.llm.warc import op5_warc

__all__ = ["ORACLE", "REGISTRY"]

REGISTRY = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chunk_bpe": op2_chunk_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_model": op4_quality_model,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_neighbours": op13_vector_neighbours,
}
