"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, language, licenses, line_dedup, packing, pieces, simhash, token_files, topk

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_topk": topk.op2_topk,
    "op3_chat": chat.op3_chat,
    "op4_licenses": licenses.op4_licenses,
    "op5_token_files": token_files.op5_token_files,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_language": language.op9_language,
    "op10_packing": packing.op10_packing,
}

#: For the others there is no SQL; tests hold them against brute force, round trips or held-out labels.
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_topk": topk.SQL,
    "op3_chat": chat.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
