"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .decontaminate import OP5_SQL, op5_decontaminate
from .html_text import op9_html_text
from .jaccard import OP8_SQL, op8_jaccard_components
from .language import op2_language_id
from .lattice import op10_lattice_scores
from .license_scan import op6_license_scan
from .quality import OP3_SQL, op3_repetition_quality
from .resampling import op13_importance_resampling
from .token_counts import op4_token_counts
from .top_products import OP12_SQL, op12_top_products
from .warc import OP7_SQL, op7_warc_zip
from .whitening import op11_whitening

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_repetition_quality": op3_repetition_quality,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op7_warc_zip": op7_warc_zip,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_html_text": op9_html_text,
    "op10_lattice_scores": op10_lattice_scores,
    "op11_whitening": op11_whitening,
    "op12_top_products": op12_top_products,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {"op3_repetition_quality": OP3_SQL, "op5_decontaminate": OP5_SQL, "op7_warc_zip": OP7_SQL, "op8_jaccard_components": OP8_SQL, "op12_top_products": OP12_SQL}
