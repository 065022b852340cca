"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from bitloom.llm import bpe, decontaminate, embeddings, jaccard, langid, lm, quality, secrets, token_files, warc

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_warc": warc.op2_warc,
    "op3_token_files": token_files.op3_token_files,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_language": langid.op8_language,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op4_decontaminate": decontaminate.SQL,
}
