"""Registered queries of this folder and their DuckDB twins."""

from __future__ import annotations

from hyrank.llm import ann, chat, collocations, decontam, jaccard, langid, licenses, linededup, mixing, quality, repair, suffix, warc

QUERIES = {
    "op1_line_dedup": linededup.op1,
    "op2_quality": quality.op2,
    "op3_decontaminate": decontam.op3,
    "op4_chat": chat.op4,
    "op5_jaccard": jaccard.op5,
    "op6_ann": ann.op6,
    "op7_suffix": suffix.op7,
    "op8_mix": mixing.op8,
    "op9_licenses": licenses.op9,
    "op10_warc": warc.op10,
    "op11_langid": langid.op11,
    "op12_collocations": collocations.op12,
    "op13_repair": repair.op13,
}

ORACLE = {
    "op3_decontaminate": decontam.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_repair": repair.ORACLE,
}
