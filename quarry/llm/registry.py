"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from quarry.llm import chat, decontaminate, line_dedup, oracles
from quarry.llm.ann import op8_kmeans_tree_search
from quarry.llm.chat import op9_chat_formatting
from quarry.llm.decontaminate import op10_benchmark_decontamination
from quarry.llm.jaccard_join import op5_jaccard_join
from quarry.llm.language import op2_language_id
from quarry.llm.line_dedup import op3_line_dedup
from quarry.llm.packing import op7_best_fit_packing
from quarry.llm.periodic import op13_periodic_runs
from quarry.llm.secrets import op1_secret_scan
from quarry.llm.sharding import op6_minimax_sharding
from quarry.llm.spelling import op12_spelling_variants
from quarry.llm.spotsigs import op11_spot_signatures
from quarry.llm.token_files import op4_token_files

QUERIES = [op1_secret_scan, op2_language_id, op3_line_dedup, op4_token_files, op5_jaccard_join, op6_minimax_sharding,
           op7_best_fit_packing, op8_kmeans_tree_search, op9_chat_formatting, op10_benchmark_decontamination,
           op11_spot_signatures, op12_spelling_variants, op13_periodic_runs]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result."""
    return {"op1_secret_scan": oracles.secret_scan(), "op5_jaccard_join": oracles.JACCARD,
            "op3_line_dedup": line_dedup.ORACLE, "op9_chat_formatting": chat.oracle(),
            "op10_benchmark_decontamination": decontaminate.ORACLE}
