"""Registered queries against their SQL at the smallest scale.

A cross-section by default; set ``EARTHFRAME_ALL=1`` for every query.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference

CROSS_SECTION = {
    "masked_index_statistics", "a1_a2_index_statistics", "p5_exact_comparison", "a6_pixel_quality",
    "a7_class_counts", "j1_band_pair", "j2_coregister", "a4_temporal_change", "p40_display_stretch",
    "a8_backscatter_statistics", "p45_sar_warnings", "p17_same_grid", "p18_nesting",
    "j6_discover", "s4_page_accounting", "w1_optical_scene_choice", "a12_execution_status",
    "w8_shown_window", "s1_normalise_scenes", "p21_scene_rule_cascade", "j16_p22_aoi_coverage",
    "p15_radiometric_status", "p25_request_cascade", "p34_href_policy", "p36_execution_audit",
    "w3_consecutive_pairs", "p32_limitations", "p44_temporal_warnings", "f9_f11_answer_verdict",
    "f18_date_expressions", "f21_f22_question_flags", "f24_operation_routing", "j16_scene_area_pairs", "a23_document_frequency",
    "f16_m1_tfidf_weights", "m6_evaluate_sets", "m6_before_after", "s11_evaluation_sink",
    "a18_threshold_table", "w7_single_slot", "x2_first_seen", "a22_stage_summary",
}
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES if os.environ.get("EARTHFRAME_ALL") else CROSS_SECTION)


def test_registry_is_consistent():
    assert CROSS_SECTION <= set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, entry.queries()[name], ORACLES[name], sf_dir) is None
