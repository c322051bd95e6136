"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline

from . import bpe_reuse, hmm, langid, licenses, matroska, mixing, near_dedup, packing, periodic, prefix_trie, quality, substring_dedup, warc_audit

_QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": packing.op1_packing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language": langid.op3_language,
    "op4_matroska": matroska.op4_matroska,
    "op5_warc_audit": warc_audit.op5_warc_audit,
    "op6_licenses": licenses.op6_licenses,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_hmm": hmm.op8_hmm,
    "op9_bpe_reuse": bpe_reuse.op9_bpe_reuse,
    "op10_quality": quality.op10_quality,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_periodic": periodic.op12_periodic,
    "op13_mixing": mixing.op13_mixing,
}
_ORACLES: dict[str, str] = {"op5_warc_audit": warc_audit.ORACLE_SQL, "op6_licenses": licenses.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
