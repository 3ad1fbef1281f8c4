"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from siltstone.llm import bpe_codec, decontaminate, exact_dedup, jaccard_join, language_id, learned_ann, lexical_search, merkle, quality_cnn, token_counts, url_filter, warc, wrapper

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_url_filter": url_filter.query,
    "op3_decontaminate": decontaminate.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_warc": warc.query,
    "op6_wrapper": wrapper.query,
    "op7_bpe_codec": bpe_codec.query,
    "op8_language_id": language_id.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_quality_cnn": quality_cnn.query,
    "op11_lexical_search": lexical_search.query,
    "op12_learned_ann": learned_ann.query,
    "op13_merkle": merkle.query,
}
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
