"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (divergence, langid, mixing, neardup, neighbours, packing, phrases, private, quality, scoring, secrets,
               sharding, substrings)

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_pack": packing.op2_pack,
    "op3_neardup": neardup.op3_neardup,
    "op4_secrets": secrets.op4_secrets,
    "op5_quality": quality.op5_quality,
    "op6_substrings": substrings.op6_substrings,
    "op7_langid": langid.op7_langid,
    "op8_nearest": neighbours.op8_nearest,
    "op9_score": scoring.op9_score,
    "op10_shards": sharding.op10_shards,
    "op11_phrases": phrases.op11_phrases,
    "op12_audit": divergence.op12_audit,
    "op13_private": private.op13_private,
}

SQL = {
    "op1_mix": mixing.SQL,
    "op11_phrases": phrases.SQL,
    "op12_audit": divergence.SQL,
}
