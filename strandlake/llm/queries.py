"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .exact_copies import OP13_SQL, op13_exact_copies
from .html_text import op2_html_text
from .jaccard import OP10_SQL, op10_jaccard_join
from .langid import op8_language_id
from .licenses import op4_license_scan
from .near_vectors import OP9_SQL, op9_near_vectors
from .packing import op6_pack_sequences
from .passages import op5_repeated_passages
from .spelling import op11_spelling_variants
from .token_counts import op7_token_counts
from .wavelet import op3_wavelet_ids
from .whitening import op12_whitened_vectors

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_text": op2_html_text,
    "op3_wavelet_ids": op3_wavelet_ids,
    "op4_license_scan": op4_license_scan,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_near_vectors": op9_near_vectors,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitened_vectors": op12_whitened_vectors,
    "op13_exact_copies": op13_exact_copies,
}

SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op9_near_vectors": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op13_exact_copies": OP13_SQL}
