"""The queries of this package and their SQL."""

from __future__ import annotations

from docmill.llm.ann import op8_ann
from docmill.llm.chat_format import op1_chat_format
from docmill.llm.filter_audit import OP13_SQL, op13_filter_audit
from docmill.llm.jaccard import OP2_SQL, op2_ngram_jaccard
from docmill.llm.language_id import op4_language_id
from docmill.llm.licenses import op6_license_scan
from docmill.llm.mixing import OP5_SQL, op5_mixing
from docmill.llm.packing import op3_packing
from docmill.llm.quality import op10_quality
from docmill.llm.runs import op11_periodic_runs
from docmill.llm.simhash import op12_simhash
from docmill.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from docmill.llm.topk import OP9_SQL, op9_topk

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_ngram_jaccard, op3_packing, op4_language_id, op5_mixing, op6_license_scan, op7_suffix_dedup, op8_ann, op9_topk, op10_quality, op11_periodic_runs, op12_simhash, op13_filter_audit)}
ORACLES = {"op2_ngram_jaccard": OP2_SQL, "op5_mixing": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op9_topk": OP9_SQL, "op13_filter_audit": OP13_SQL}
