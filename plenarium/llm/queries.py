"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .chat import op8_chat_format
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op4_language_id
from .line_dedup import op7_line_dedup
from .near_dedup import op5_near_dedup
from .neighbours import op13_near_neighbours
from .packing import op9_packing
from .pii import op6_pii
from .sentencepieces import op10_sentencepieces
from .sharding import op1_sharding
from .topk import OP2_SQL, op2_exact_topk
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_exact_topk": op2_exact_topk,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_sentencepieces": op10_sentencepieces,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_neighbours": op13_near_neighbours,
}
ORACLE_SQL = {
    "op2_exact_topk": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
