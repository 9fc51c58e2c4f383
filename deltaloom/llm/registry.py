"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, packing, secrets, sharding, simhash, suffix_dedup, token_counts, toxicity, warc, weighted_sampling

QUERIES = {
    "op1_feistel_sharding": sharding.op1_feistel_sharding,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc_archive": warc.op3_warc_archive,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_weighted_fingerprints": weighted_sampling.op6_weighted_fingerprints,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op3_warc_archive": warc.OP3_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
}
