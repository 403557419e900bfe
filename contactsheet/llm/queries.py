"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import ann, bpe, exact, grammar, html, langid, minhash, packing, periodic, pii, repair, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact_dedup": exact.op3_exact_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op5_packing": packing.op5_packing,
    "op6_main_text": html.op6_main_text,
    "op7_nearest": ann.op7_nearest,
    "op8_pii": pii.op8_pii,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_ids": grammar.op10_token_ids,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_language_id": langid.op12_language_id,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {"op3_exact_dedup": exact.OP3_SQL, "op7_nearest": ann.OP7_SQL, "op11_conversation_repair": repair.OP11_SQL}
