"""Queries of this subpackage and their DuckDB SQL."""

from . import decontaminate, huffman, langid, mixture, neardup, packing, sharding, suffixes, topk, toxicity, trie, urls, variants


def queries():
    return {
        "op1_toxic_spans": toxicity.op1_toxic_spans,
        "op2_url_filter": urls.op2_url_filter,
        "op3_repeated_passages": suffixes.op3_repeated_passages,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op5_extendible_shards": sharding.op5_extendible_shards,
        "op6_language_id": langid.op6_language_id,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_pivot_topk": topk.op9_pivot_topk,
        "op10_huffman_ids": huffman.op10_huffman_ids,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_mixture_packing": mixture.op13_mixture_packing,
    }


def oracle_sql():
    return {
        "op4_near_duplicates": neardup.OP4_SQL,
        "op5_extendible_shards": sharding.OP5_SQL,
        "op8_decontamination": decontaminate.OP8_SQL,
        "op9_pivot_topk": topk.OP9_SQL,
        "op11_spelling_variants": variants.OP11_SQL,
        "op12_conversation_trie": trie.OP12_SQL,
    }
