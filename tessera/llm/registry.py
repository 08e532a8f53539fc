"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import bpe, collocations, exact_dedup, html_extract, langid, mixing, ngram_join, pieces, quality, substring_dedup, url_filter, vector_codes, warc

QUERIES = {
    "op1_url_filter": url_filter.op1,
    "op2_bpe": bpe.op2,
    "op3_warc": warc.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_language_id": langid.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_html_extraction": html_extract.op7,
    "op8_ngram_join": ngram_join.op8,
    "op9_quality_rules": quality.op9,
    "op10_mixing": mixing.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_sentencepiece": pieces.op12,
    "op13_collocations": collocations.op13,
}
#: Merge tables, trained models and their texts are not SQL; tests hold op2, op5, op7, op12 and the pipeline against plain twins.
SQL = {
    "op1_url_filter": url_filter.op1_sql(),
    "op3_warc": warc.op3_sql(),
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_quality_rules": quality.op9_sql(),
    "op10_mixing": mixing.op10_sql(),
    "op11_vector_codes": vector_codes.op11_sql(),
    "op13_collocations": collocations.OP13_SQL,
}
