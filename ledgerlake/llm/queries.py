"""The queries opN_<name> and what of them SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chroma import op2_chroma_align
from .dac import op7_dac_tokens
from .langid import op10_centroid_langid
from .near_dups import op6_hamming_near_dups
from .pfair import OP4_SQL, op4_pfair_mix
from .pieces import op5_nbest_pieces
from .pii import op8_skipchain_pii
from .recipes import OP1_SQL, op1_chunk_recipe_dedup
from .site_lines import OP9_SQL, op9_site_line_dedup
from .toxicity import op3_fm_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_recipe_dedup": op1_chunk_recipe_dedup,
    "op2_chroma_align": op2_chroma_align,
    "op3_fm_toxicity": op3_fm_toxicity,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_hamming_near_dups": op6_hamming_near_dups,
    "op7_dac_tokens": op7_dac_tokens,
    "op8_skipchain_pii": op8_skipchain_pii,
    "op9_site_line_dedup": op9_site_line_dedup,
    "op10_centroid_langid": op10_centroid_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chunk_recipe_dedup": OP1_SQL,
    "op4_pfair_mix": OP4_SQL,
    "op9_site_line_dedup": OP9_SQL,
}
