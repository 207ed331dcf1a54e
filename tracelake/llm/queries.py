"""Queries of the training-data operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_pivots, op2_wavelet, op3_lines, op4_decontaminate, op5_pii, op6_jaccard, op7_html, op8_chat, op9_mix, op10_quality, op11_audit, op12_licenses, op13_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_permutation": op1_pivots.op1_pivot_permutation,
        "op2_wavelet_tokens": op2_wavelet.op2_wavelet_tokens,
        "op3_line_windows": op3_lines.op3_line_windows,
        "op4_positional_index": op4_decontaminate.op4_positional_index,
        "op4_phrase_and_proximity": op4_decontaminate.op4_phrase_and_proximity,
        "op5_pii_anchors": op5_pii.op5_pii_anchors,
        "op6_vertical_jaccard": op6_jaccard.op6_vertical_jaccard,
        "op7_dom_trees": op7_html.op7_dom_trees,
        "op8_snapshot_chat": op8_chat.op8_snapshot_chat,
        "op9_fair_mix": op9_mix.op9_fair_mix,
        "op10_byte_cnn": op10_quality.op10_byte_cnn,
        "op11_filter_audit": op11_audit.op11_filter_audit,
        "op12_license_scan": op12_licenses.op12_license_scan,
        "op13_spelling_variants": op13_variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_windows": op3_lines.ORACLE, "op8_snapshot_chat": op8_chat.ORACLE, "op4_positional_index": op4_decontaminate.ORACLE, "op6_vertical_jaccard": op6_jaccard.ORACLE, "op9_fair_mix": op9_mix.ORACLE, "op11_filter_audit": op11_audit.ORACLE, "op12_license_scan": op12_licenses.ORACLE, "op13_spelling_variants": op13_variants.ORACLE}
