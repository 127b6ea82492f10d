"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from gridstone.llm import bpe, clusters, exact_dedup, hard_negatives, html_text, packing, quality_bayes, quality_rules, secrets, simhash, syncmers, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_html_text": html_text.op4_html_text,
    "op5_quality_bayes": quality_bayes.op5_quality_bayes,
    "op6_syncmer_fingerprints": syncmers.op6_syncmer_fingerprints,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_simhash_components": simhash.op10_simhash_components,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_exponion_clusters": clusters.op13_exponion_clusters,
}

#: Queries that SQL can express; the tests hold the others against brute force.
ORACLE_SQL = {
    "op3_url_filter": url_filter.oracle(),
    "op7_warc_round_trip": warc.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_exponion_clusters": clusters.oracle(),
}
