"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from siltseek.llm.decontamination import OP9_SQL, op9_decontamination
from siltseek.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from siltseek.llm.lm_scoring import op10_lm_scoring
from siltseek.llm.near_dedup import OP4_SQL, op4_near_dedup
from siltseek.llm.packing import op8_packing
from siltseek.llm.quality import op5_quality
from siltseek.llm.repeated_windows import OP7_SQL, op7_repeated_windows
from siltseek.llm.sharding import op2_sharding
from siltseek.llm.token_counts import op3_token_counts
from siltseek.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_repeated_windows": op7_repeated_windows,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
}
ORACLE_SQL = {
    "op4_near_dedup": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_repeated_windows": OP7_SQL,
    "op9_decontamination": OP9_SQL,
}
