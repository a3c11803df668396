"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from .backoff_lm import op10_backoff_lm
from .block_topk import ORACLE_OP7, op7_block_topk
from .byte_bpe import op5_byte_bpe
from .near_dedup import op6_near_dedup
from .one_bit_ann import op2_one_bit_ann
from .oracles import ORACLE_OP6, ORACLE_OP10
from .packing import op3_packing
from .quality import op9_quality
from .ring_sharding import op8_ring_sharding
from .toxicity import op1_toxicity
from .warc import ORACLE_OP4, op4_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_one_bit_ann": op2_one_bit_ann,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_dedup": op6_near_dedup,
    "op7_block_topk": op7_block_topk,
    "op8_ring_sharding": op8_ring_sharding,
    "op9_quality": op9_quality,
    "op10_backoff_lm": op10_backoff_lm,
}
ORACLES = {"op4_warc": ORACLE_OP4, "op6_near_dedup": ORACLE_OP6, "op7_block_topk": ORACLE_OP7, "op10_backoff_lm": ORACLE_OP10}
