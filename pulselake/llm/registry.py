"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, importance, licenses, lines, media, mixing, ngram_join, packing, quality, sharding, substrings, toxicity, trie

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_chat": chat.op3_chat,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_substrings": substrings.op9_substrings,
    "op10_media": media.op10_media,
    "op11_sharding": sharding.op11_sharding,
    "op12_importance": importance.op12_importance,
    "op13_trie": trie.op13_trie,
}
SQL = {"op3_chat": chat.OP3_SQL, "op7_mixing": mixing.OP7_SQL, "op11_sharding": sharding.OP11_SQL, "op12_importance": importance.OP12_SQL, "op13_trie": trie.OP13_SQL}
