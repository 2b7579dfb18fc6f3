"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import bpe, chat, decontaminate, neardup, pii, quality, secrets, setjoin, spelling, topk, toxicity, trie, url_rules

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_quality": quality.op3_quality,
    "op4_chat": chat.op4_chat,
    "op5_secrets": secrets.op5_secrets,
    "op6_pii": pii.op6_pii,
    "op7_neardup": neardup.op7_neardup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_topk": topk.op10_topk,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_spelling": spelling.op12_spelling,
    "op13_jaccard_join": setjoin.op13_jaccard_join,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_url_rules": url_rules.ORACLE,
    "op4_chat": chat.ORACLE,
    "op7_neardup": neardup.ORACLE,
    "op10_topk": topk.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_jaccard_join": setjoin.ORACLE,
}
