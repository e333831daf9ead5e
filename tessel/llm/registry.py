"""The queries of this subpackage, and SQL for those that DuckDB can express."""

from tessel.llm.bpe import op7_bpe_encoding
from tessel.llm.chat import OP1_SQL, op1_chat_formatting
from tessel.llm.maxent import op8_lm_scoring
from tessel.llm.neardup import OP4_SQL, op4_near_duplicates
from tessel.llm.neighbours import op9_nearest_neighbours
from tessel.llm.packing import op6_best_fit_packing
from tessel.llm.perplexity import op3_quality_rules
from tessel.llm.quality import op10_quality
from tessel.llm.spelling import op13_spelling_variants
from tessel.llm.toxicity import op5_toxicity
from tessel.llm.urls import op12_url_filter
from tessel.llm.warc import op2_warc_derivatives
from tessel.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_warc_derivatives, op3_quality_rules, op4_near_duplicates, op5_toxicity, op6_best_fit_packing, op7_bpe_encoding, op8_lm_scoring, op9_nearest_neighbours, op10_quality, op11_whitening, op12_url_filter, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op4_near_duplicates": OP4_SQL}
