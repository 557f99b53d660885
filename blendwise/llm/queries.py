"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from blendwise.llm import (bestfit, chat, collocations, decontam, infilling, langid, licenses, neardup, sharding, simhash, substrings,
                           suffixes, warc)

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_best_fit_packing": bestfit.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_warc": warc.op5_warc,
    "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_suffix_array_dedup": suffixes.op12_suffix_array_dedup,
    "op13_fill_in_middle": infilling.op13_fill_in_middle,
}
ORACLE: dict[str, str] = {
    "op11_phrase_collocations": collocations.OP11_SQL.strip(),
    "op13_fill_in_middle": infilling.OP13_SQL.strip(),
}
