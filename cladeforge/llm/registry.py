"""The queries of this package and the SQL of those that SQL can express."""

from cladeforge.llm import chat, decontaminate, fingerprint, licenses, packing, secrets, sharding, simhash, suffix, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_chat_format": chat.op4_chat_format,
    "op5_document_fingerprints": fingerprint.op5_document_fingerprints,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_license_scan": licenses.op9_license_scan,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
}
ORACLE_SQL = {
    "op9_license_scan": licenses.OP9_SQL,
    "op1_secret_scan": secrets.OP1_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op4_chat_format": chat.OP4_SQL,
}
