"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillmesh.llm import audio, chat, fingerprint, langid, mixing, neardup, pfor, pieces, pii, secrets

QUERIES = {
    "op1_linked_secrets": secrets.query,
    "op2_audio_features": audio.query,
    "op3_pfor_token_blocks": pfor.query,
    "op4_semi_markov_pii": pii.query,
    "op5_nbest_pieces": pieces.query,
    "op6_reply_trees": chat.query,
    "op7_document_fingerprints": fingerprint.query,
    "op8_mix_to_target_weights": mixing.query,
    "op9_minhash_odd_sketches": neardup.query,
    "op10_kneser_ney_language_id": langid.query,
}

ORACLE_SQL = {
    "op6_reply_trees": chat.ORACLE,
    "op8_mix_to_target_weights": mixing.ORACLE,
    "op9_minhash_odd_sketches": neardup.ORACLE,
}
