"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from keyloom.llm import decontaminate, embeddings, html_text, importance, licenses, line_chunks, minhash, mixing, pieces, preferences, search, sharding, toxicity

QUERIES = {
    "op1_lexicon": toxicity.op1_lexicon,
    "op2_hyperplanes": embeddings.op2_hyperplanes,
    "op3_preferences": preferences.op3_preferences,
    "op4_line_chunks": line_chunks.op4_line_chunks,
    "op5_mix": mixing.op5_mix,
    "op6_virtual_slots": sharding.op6_virtual_slots,
    "op7_minhash": minhash.op7_minhash,
    "op8_dom_trees": html_text.op8_dom_trees,
    "op9_suffix_array": decontaminate.op9_suffix_array,
    "op10_patience": licenses.op10_patience,
    "op11_resample": importance.op11_resample,
    "op12_prefix_table": pieces.op12_prefix_table,
    "op13_tiered": search.op13_tiered,
}

ORACLE_SQL = {
    "op2_hyperplanes": embeddings.OP2_SQL,
    "op3_preferences": preferences.OP3_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op9_suffix_array": decontaminate.OP9_SQL,
    "op11_resample": importance.OP11_SQL,
    "op13_tiered": search.OP13_SQL,
}
