"""The operators as queries over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import attention_lm, chat, cotraining, decontaminate, langid, line_dedup, mixing, simhash, token_files, winnowing

QUERIES = {
    "op1_perspective_rotation": chat.op1_perspective_rotation,
    "op2_language_bitmask": langid.op2_language_bitmask,
    "op3_cotraining": cotraining.op3_cotraining,
    "op4_attention_lm": attention_lm.op4_attention_lm,
    "op5_winnowing": winnowing.op5_winnowing,
    "op6_systematic_mix": mixing.op6_systematic_mix,
    "op7_line_hash_dedup": line_dedup.op7_line_hash_dedup,
    "op8_simhash_components": simhash.op8_simhash_components,
    "op9_huffman_token_files": token_files.op9_huffman_token_files,
    "op10_wu_manber": decontaminate.op10_wu_manber,
}

ORACLE_SQL = {
    "op1_perspective_rotation": chat.ORACLE_SQL,
    "op6_systematic_mix": mixing.ORACLE_SQL,
    "op7_line_hash_dedup": line_dedup.ORACLE_SQL,
    "op10_wu_manber": decontaminate.ORACLE_SQL,
}
