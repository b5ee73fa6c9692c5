"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import langid, media, ngram_join, packing, pieces, quality, secrets, token_store, urls, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_secret_crf": secrets.op2,
    "op3_language_embeddings": langid.op3,
    "op4_media_chunks": media.op4,
    "op5_redirect_equivalence": urls.op5,
    "op6_risk_controlled_quality": quality.op6,
    "op7_power_of_two_packing": packing.op7,
    "op8_piece_merge_dropout": pieces.op8,
    "op9_warc_revisits": warc.op9,
    "op10_token_store": token_store.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op5_redirect_equivalence": urls.SQL,
    "op6_risk_controlled_quality": quality.SQL,
    "op9_warc_revisits": warc.SQL,
}
