"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import op1_language as _op1
from . import op10_binary as _op10
from . import op2_shard as _op2
from . import op3_fingerprint as _op3
from . import op4_toxicity as _op4
from . import op5_decontaminate as _op5
from . import op6_sentencepiece as _op6
from . import op7_tokens as _op7
from . import op8_jaccard as _op8
from . import op9_secrets as _op9

QUERIES = {
    "op1_language": _op1.op1,
    "op2_shard": _op2.op2,
    "op3_fingerprint": _op3.op3,
    "op4_toxicity": _op4.op4,
    "op5_decontaminate": _op5.op5,
    "op6_sentencepiece": _op6.op6,
    "op7_token_counts": _op7.op7,
    "op8_jaccard_join": _op8.op8,
    "op9_secrets": _op9.op9,
    "op10_binary": _op10.op10,
}

ORACLE_SQL = {
    "op2_shard": _op2.OP2_SQL,
    "op5_decontaminate": _op5.OP5_SQL,
    "op8_jaccard_join": _op8.OP8_SQL,
    "op9_secrets": _op9.OP9_SQL,
}
