"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fim, hardneg, langid, neardup, ngramlm, ogg, packing, separators, simhash, toxicity, urlfilter, warc

QUERIES = {
    "op1_token_separators": separators.op1_token_separators,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_language_id": langid.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc_archive": warc.op6_warc_archive,
    "op7_pack_sequences": packing.op7_pack_sequences,
    "op8_ogg_media": ogg.op8_ogg_media,
    "op9_lm_scores": ngramlm.op9_lm_scores,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_simhash": simhash.op12_simhash,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}
ORACLE_SQL = {
    "op2_url_filter": urlfilter.ORACLE,
    "op3_near_duplicates": neardup.ORACLE,
    "op6_warc_archive": warc.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_hard_negatives": hardneg.ORACLE,
}
