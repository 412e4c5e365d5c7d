"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from covercost.llm import (
    byte_bpe,
    collocations,
    decontamination,
    language_id,
    lexical_search,
    license_scan,
    minhash_dedup,
    pii,
    quality_ranking,
    quality_rules,
    suffix_dedup,
    toxicity,
    warc,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc_index": warc.op2_warc_index,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_ranking": quality_ranking.op6_quality_ranking,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {
    "op2_warc_index": warc.oracle(),
    "op3_quality_rules": quality_rules.oracle(),
    "op7_minhash_dedup": minhash_dedup.oracle(),
    "op11_license_scan": license_scan.oracle(),
    "op12_collocations": collocations.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
