"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from isobath.llm import audio, chat, decontamination, importance, language_id, line_dedup, mixing, near_dedup, periodic_runs, substring_dedup, suffix_dedup, url_filter, warc

QUERIES = {
    "op7_audio_features": audio.op7_audio_features,
    "op6_warc": warc.op6_warc,
    "op3_language_id": language_id.op3_language_id,
    "op9_decontamination": decontamination.op9_decontamination,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_url_filters": url_filter.op13_url_filters,
}
ORACLES = {
    "op6_warc": warc.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op13_url_filters": url_filter.ORACLE,
}
