"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, topk_search, vector_codes
from .collocations import op12_collocations
from .fingerprints import op5_fingerprints
from .jaccard import op3_jaccard_join
from .language_id import op13_language_id
from .lm_scoring import op1_lm_scoring
from .mixing import op6_mixing
from .packing import op4_packing
from .pii import op7_pii
from .quality import op10_quality
from .substrings import op8_substrings
from .topk_search import op2_topk_search
from .toxicity import op9_toxicity
from .vector_codes import op11_vector_codes

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_topk_search, op3_jaccard_join, op4_packing, op5_fingerprints, op6_mixing, op7_pii, op8_substrings, op9_toxicity, op10_quality, op11_vector_codes, op12_collocations, op13_language_id)}
SQL: dict[str, str] = {"op2_topk_search": topk_search.SQL, "op11_vector_codes": vector_codes.SQL, "op12_collocations": collocations.SQL}
