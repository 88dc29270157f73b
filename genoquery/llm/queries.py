"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoquery.llm import chat, topk
from genoquery.llm.blocks import op1_block_labeller
from genoquery.llm.chat import op2_chat_fingerprint
from genoquery.llm.decontaminate import op6_string_tiling
from genoquery.llm.jaccard_join import op9_ngram_jaccard_join
from genoquery.llm.packing import op8_dynamic_packing
from genoquery.llm.quality import op3_quality_trees
from genoquery.llm.substring_dedup import op10_compact_windows
from genoquery.llm.token_counts import op4_offset_token_counts
from genoquery.llm.topk import op7_block_max_topk
from genoquery.llm.toxicity import op5_toxic_instances


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_block_labeller": op1_block_labeller,
        "op2_chat_fingerprint": op2_chat_fingerprint,
        "op3_quality_trees": op3_quality_trees,
        "op4_offset_token_counts": op4_offset_token_counts,
        "op5_toxic_instances": op5_toxic_instances,
        "op6_string_tiling": op6_string_tiling,
        "op7_block_max_topk": op7_block_max_topk,
        "op8_dynamic_packing": op8_dynamic_packing,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_compact_windows": op10_compact_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_fingerprint": chat.SQL, "op7_block_max_topk": topk.SQL}
