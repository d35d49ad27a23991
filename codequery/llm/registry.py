"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import op1_url_filters as op1
from . import op2_embedding_near_dedup as op2
from . import op3_byte_bpe as op3
from . import op4_quality_classifier as op4
from . import op5_lm_scoring as op5
from . import op6_line_dedup as op6
from . import op7_language_id as op7
from . import op8_simhash_near_dedup as op8
from . import op9_media_columns as op9
from . import op10_best_fit_packing as op10


def queries() -> dict:
    found = (
        op1.op1_url_filters,
        op2.op2_embedding_near_dedup,
        op3.op3_byte_bpe,
        op4.op4_quality_classifier,
        op5.op5_lm_scoring,
        op6.op6_line_dedup,
        op7.op7_language_id,
        op8.op8_simhash_near_dedup,
        op9.op9_media_columns,
        op10.op10_best_fit_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {}
