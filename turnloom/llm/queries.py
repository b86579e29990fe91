"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import dedup, mixing, neardup, packing, pii, quality, sharding, tokens, topk, urls

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pack": packing.op2_pack,
    "op3_url_filter": urls.op3_url_filter,
    "op4_exact_dedup": dedup.op4_exact_dedup,
    "op5_pii": pii.op5_pii,
    "op6_near_dedup": neardup.op6_near_dedup,
    "op7_mix": mixing.op7_mix,
    "op8_quality": quality.op8_quality,
    "op9_tokens": tokens.op9_tokens,
    "op10_shard": sharding.op10_shard,
}
SQL = {"op1_topk": topk.SQL, "op3_url_filter": urls.SQL, "op4_exact_dedup": dedup.SQL, "op7_mix": mixing.SQL, "op10_shard": sharding.SQL}
