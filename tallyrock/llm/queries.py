"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, near, packing, pii, quality, sharding, suffixes, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op10_near": near.op10_near,
    "op2_decontam": decontam.op2_decontam,
    "op3_chat": chat.op3_chat,
    "op4_sharding": sharding.op4_sharding,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
}
ORACLES = {
    "op3_chat": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_quality": quality.ORACLE,
    "op7_suffixes": suffixes.ORACLE,
    "op10_near": near.ORACLE,
}
