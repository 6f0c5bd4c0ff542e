"""Queries of the training-data operators, and SQL for those that SQL can express."""

from quarrymill.llm.chat import OP4_SQL, op4_chat_formatting
from quarrymill.llm.divergence import OP12_SQL, op12_divergence
from quarrymill.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from quarrymill.llm.mixing import OP1_SQL, op1_mixing
from quarrymill.llm.packing import op5_best_fit_packing
from quarrymill.llm.pii import op9_pii
from quarrymill.llm.point_in_time import OP13_SQL, op13_point_in_time
from quarrymill.llm.quality import OP10_SQL, op10_quality_rules
from quarrymill.llm.repeats import op6_substring_dedup
from quarrymill.llm.secret_scan import op11_secrets
from quarrymill.llm.shingle_join import op3_ngram_jaccard
from quarrymill.llm.token_count import op8_token_counts
from quarrymill.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_secrets": op11_secrets,
    "op12_divergence": op12_divergence,
    "op13_point_in_time": op13_point_in_time,
}

ORACLES = {"op1_mixing": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op10_quality_rules": OP10_SQL, "op12_divergence": OP12_SQL, "op13_point_in_time": OP13_SQL}
