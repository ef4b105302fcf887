"""The operators of this package applied to the whole test tables, and the same as SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelloom.llm import (
    chat,
    decontaminate,
    fingerprints,
    huffman,
    licenses,
    line_dedup,
    packing,
    quality,
    repair,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_counts,
)
from labelloom.llm.common import table


def op1_token_counts(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": fingerprints.query,
    "op3_simhash_dedup": simhash_dedup.query,
    "op4_chat_format": chat.query,
    "op5_huffman_ids": huffman.query,
    "op6_quality": quality.query,
    "op7_packing": packing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_line_dedup": line_dedup.query,
    "op10_licenses": licenses.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_spelling_variants": spelling.query,
    "op13_conversation_repair": repair.query,
}

ORACLES = {"op4_chat_format": chat.ORACLE}
