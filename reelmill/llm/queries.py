"""The corpus queries by name and their oracle SQL; ``__spark_entry__`` adds them when this package is there."""

from __future__ import annotations

from reelmill.llm import balltree, extraction, infill, langid, negatives, packing, parity, pieces, sharding, simhash, substrings, toxicity, winnowing

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op10_pieces": pieces.op10_pieces,
    "op11_infill": infill.op11_infill,
    "op12_parity": parity.op12_parity,
    "op13_negatives": negatives.op13_negatives,
    "op2_sharding": sharding.op2_sharding,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_extraction": extraction.op6_extraction,
    "op7_substrings": substrings.op7_substrings,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_balltree": balltree.op9_balltree,
}

ORACLE_SQL = {
    "op11_infill": infill.OP11_SQL,
    "op12_parity": parity.OP12_SQL,
    "op13_negatives": negatives.OP13_SQL,
    "op2_sharding": sharding.OP2_SQL,
    "op7_substrings": substrings.OP7_SQL,
    "op9_balltree": balltree.OP9_SQL,
}
