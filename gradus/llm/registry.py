"""Queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from . import ann, audit, bpe, chat, merkle, mixing, packing, pii, quality, secrets, simhash, token_files, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_pii": pii.op4_pii,
    "op5_ann": ann.op5_ann,
    "op6_secrets": secrets.op6_secrets,
    "op7_chat": chat.op7_chat,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_files": token_files.op9_token_files,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_audit": audit.op11_audit,
    "op12_merkle": merkle.op12_merkle,
    "op13_packing": packing.op13_packing,
}

ORACLE: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op7_chat": chat.ORACLE,
    "op11_audit": audit.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
