"""The registered queries of this subpackage, and their SQL."""

from gridloom.llm import bpe, decontam, exact, langid, minhash, oracles, phrases, quality, secrets, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_remove_repeats": phrases.op2_remove_repeats,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_minhash_dedup": minhash.op4_minhash_dedup,
    "op5_quality": quality.op5_quality,
    "op6_language": langid.op6_language,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": bpe.op9_token_counts,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

SQL = {
    "op1_secret_scan": oracles.OP1,
    "op2_remove_repeats": oracles.OP2,
    "op3_decontaminate": oracles.OP3,
    "op4_minhash_dedup": oracles.OP4,
    "op7_exact_dedup": exact.OP7_SQL,
}
