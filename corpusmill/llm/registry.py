"""The operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, importance, language, linededup, neardup, packing, privacy, quality, sharding, spelling, subword, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_perspective_rotation": chat.op1_perspective_rotation,
        "op10_zstd_language": language.op10_zstd_language,
        "op2_dart_minhash": neardup.op2_dart_minhash,
        "op4_hilbert_packing": packing.op4_hilbert_packing,
        "op6_levelled_line_runs": linededup.op6_levelled_line_runs,
        "op7_warc_history": warc.op7_warc_history,
        "op9_positional_index": decontaminate.op9_positional_index,
        "op5_disclosure": privacy.op5_disclosure,
        "op8_kneser_ney_quality": quality.op8_kneser_ney_quality,
        "op3_feistel_shards": sharding.op3_feistel_shards,
        "op11_crc_ring": importance.op11_crc_ring,
        "op12_errata_trie": spelling.op12_errata_trie,
        "op13_subword_quality": subword.op13_subword_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_perspective_rotation": chat.ORACLE,
        "op6_levelled_line_runs": linededup.ORACLE,
        "op9_positional_index": decontaminate.ORACLE,
        "op11_crc_ring": importance.ORACLE,
        "op12_errata_trie": spelling.ORACLE,
    }
