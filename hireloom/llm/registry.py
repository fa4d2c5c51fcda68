"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op7_embedding_near_dedup
from .fingerprint import op8_document_fingerprint
from .hard_negatives import OP11_SQL, op11_hard_negative_mining
from .language_model import op9_context_mixing_lm
from .line_dedup import op3_line_dedup
from .minhash import op4_minhash_near_dedup
from .mixing import OP6_SQL, op6_source_mixing
from .packing import op1_best_fit_packing
from .quality import op10_quality_classifier
from .secret_scan import op5_secret_scan
from .toxicity import op13_toxicity
from .warc import op2_warc_boundary_chain
from .whitening import op12_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_warc_boundary_chain, op3_line_dedup, op4_minhash_near_dedup, op5_secret_scan, op6_source_mixing, op7_embedding_near_dedup, op8_document_fingerprint, op9_context_mixing_lm, op10_quality_classifier, op11_hard_negative_mining, op12_embedding_whitening, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": OP6_SQL, "op11_hard_negative_mining": OP11_SQL}
