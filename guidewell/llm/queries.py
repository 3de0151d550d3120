"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .archives import OP2_SQL, op2_warc_zip
from .embedding_dedup import op1_pca_tiles
from .language_model import op7_elias_fano_lm
from .mixing import op6_pivotal_mix
from .packing import op10_nnls_packing
from .quality_classifier import op9_lsa_quality
from .quality_rules import op5_compression_bands
from .simhash import op3_simhash_bktree
from .token_files import op8_wavelet_tokens
from .toxicity import op4_blockmax_toxicity

QUERIES = {
    "op7_elias_fano_lm": op7_elias_fano_lm,
    "op9_lsa_quality": op9_lsa_quality,
    "op4_blockmax_toxicity": op4_blockmax_toxicity,
    "op2_warc_zip": op2_warc_zip,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op10_nnls_packing": op10_nnls_packing,
    "op1_pca_tiles": op1_pca_tiles,
    "op3_simhash_bktree": op3_simhash_bktree,
    "op5_compression_bands": op5_compression_bands,
    "op6_pivotal_mix": op6_pivotal_mix,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": OP2_SQL,
}
