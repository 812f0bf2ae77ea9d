"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, collocations, decontamination, embedding_dedup, language_id, lexical_search, lm_scoring, ngram_join, quality, segmentation, substring_dedup, toxicity, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_language_id": language_id.op3,
    "op4_decontamination": decontamination.op4,
    "op5_toxicity": toxicity.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_quality": quality.op7,
    "op8_segmentation": segmentation.op8,
    "op9_chat_format": chat_format.op9,
    "op10_warc": warc.op10,
    "op11_collocations": collocations.op11,
    "op12_lm_scoring": lm_scoring.op12,
    "op13_lexical_search": lexical_search.op13,
}

ORACLE = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
