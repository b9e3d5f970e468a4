"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from millrace.llm.decontaminate import op10_decontamination
from millrace.llm.language_id import op8_language_id
from millrace.llm.line_dedup import OP7_SQL, op7_line_dedup
from millrace.llm.ngram_join import OP2_SQL, op2_ngram_jaccard_join
from millrace.llm.packing import op5_packing
from millrace.llm.quality_classifier import op6_quality_classifier
from millrace.llm.quality_rules import op9_quality_rules
from millrace.llm.secrets import op4_secret_scan
from millrace.llm.suffix_tree_lm import op3_suffix_tree_lm
from millrace.llm.warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_ngram_jaccard_join, op3_suffix_tree_lm, op4_secret_scan, op5_packing, op6_quality_classifier, op7_line_dedup, op8_language_id, op9_quality_rules, op10_decontamination)}
ORACLE = {"op1_warc": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op7_line_dedup": OP7_SQL}
