"""The training-data queries and their SQL."""

from siltstone.llm import byte_bpe, chat, fingerprints, minmax, mixing, progressive_jpeg, sharding, simple8b, substring_dedup, toxicity

QUERIES = {
    "op1_relative_lz": substring_dedup.op1_relative_lz,
    "op2_rank_queue": byte_bpe.op2_rank_queue,
    "op3_rake": mixing.op3_rake,
    "op4_perspectives": chat.op4_perspectives,
    "op5_simple8b": simple8b.op5_simple8b,
    "op6_grammar": toxicity.op6_grammar,
    "op7_progressive": progressive_jpeg.op7_progressive,
    "op8_one_permutation": fingerprints.op8_one_permutation,
    "op9_min_max": minmax.op9_min_max,
    "op10_interleave": sharding.op10_interleave,
}

ORACLES = {"op3_rake": mixing.OP3_SQL, "op4_perspectives": chat.OP4_SQL, "op9_min_max": minmax.OP9_SQL}
