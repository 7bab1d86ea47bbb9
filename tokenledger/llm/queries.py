"""The corpus operators' queries and their SQL, by registered name."""

from tokenledger.llm import credentials, crf_language, decontaminate, line_dedup, minhash, nn_descent, periodic_runs, pieces, prefix_trie, site_style, suffix_dedup, url_filter, weak_quality

_MODULES = {
    "op1_crf_language": crf_language,
    "op2_decontaminate": decontaminate,
    "op3_url_filter": url_filter,
    "op4_minhash": minhash,
    "op5_weak_quality": weak_quality,
    "op6_site_style": site_style,
    "op7_sentencepiece": pieces,
    "op8_suffix_dedup": suffix_dedup,
    "op9_nn_descent": nn_descent,
    "op10_line_dedup": line_dedup,
    "op11_prefix_trie": prefix_trie,
    "op12_periodic_runs": periodic_runs,
    "op13_credentials": credentials,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
