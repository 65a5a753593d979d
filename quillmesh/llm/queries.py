"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from . import chat, near_dup, rules, substring
from .decontam import op8_decontaminate
from .near_dup import op4_near_dup
from .pieces import op3_sentencepiece
from .quality import op7_quality
from .sharding import op2_sharding
from .substring import op6_substring_dedup
from .token_store import op5_token_store
from .toxicity import op9_toxicity

_ALL = (rules.op1_quality_rules, op2_sharding, op3_sentencepiece, op4_near_dup, op5_token_store, op6_substring_dedup, op7_quality, op8_decontaminate, op9_toxicity, chat.op10_chat_format)
QUERIES = {f.__name__: f for f in _ALL}
#: DuckDB SQL where SQL can express a query.
ORACLES: dict[str, str] = {"op1_quality_rules": rules.SQL, "op4_near_dup": near_dup.SQL, "op6_substring_dedup": substring.SQL, "op10_chat_format": chat.SQL}
