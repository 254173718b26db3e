"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from recallspark.llm import bpe, context_tree, conversation_repair, fill_middle, lattice, minhash, packing, positional_index, quality_mil, quality_rules, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_lattice": lattice.op1_lattice,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality_mil.op3_quality,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_suffix_array": suffix_dedup.op5_suffix_array,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_packing": packing.op7_packing,
    "op8_minhash": minhash.op8_minhash,
    "op9_bpe": bpe.op9_bpe,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_decontamination": positional_index.op13_decontamination,
}

ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_fill_middle": fill_middle.ORACLE_SQL,
    "op13_decontamination": positional_index.ORACLE_SQL,
}
