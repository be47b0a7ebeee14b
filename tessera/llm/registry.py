"""The registered queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import ann, conversations, exact_dedup, language_id, mixing, near_dedup, pieces, pii, quality, secrets, sharding, spelling, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_pieces": pieces.op3_pieces,
    "op4_sharding": sharding.op4_sharding,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_pii": pii.op6_pii,
    "op7_ann": ann.op7_ann,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_secrets": secrets.op11_secrets,
    "op12_conversations": conversations.op12_conversations,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
