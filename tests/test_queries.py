"""Registered queries against their SQL.  ``MILLRACE_ALL=1`` runs every query, else a selection per family."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tests.conftest import SF

SELECTION = """D1_process_window D2_D13_key_link_in_window D3_substring_link D4_nearest_time_link D5_inner_when_filtered
D8_last_per_key D9_one_per_start D11_D12_path_without_middle D15_link_simulation D19_resolve_masters D21_tolerant_matching
D24_order_scores D30_grow_dictionary E4_all_words E8_on_demand_filter E9_outliers_O6U E14_stored_duplicates E15_left_over
F13_ratio F16_log10 F22_hex_bit F32_format_combine F43_time_frame F55_or F60_regex_groups F161_F172_self_chain
F190_fill_backward_per_serial F203_cycle_time_per_facet F208_others G3_time_per_count G6_calendar_heatmap
G8_ng_rate_by_terms G9_full_summary G11_G12_G13_trimmed_summary G15_scales G17_kernel_density G19_emd_exact G24_co_occurrence_day
G27_histogram_2d G29_partial_correlations H2_thin_by_time H4_cyclic_terms_backward H7_latest_chunks H14_threshold_in_force
H19_day_ranges A2_read_transposed A18_A19_rows_by_month A20_backup_restore A21_import_good A23_ingest_folder B2_import_types
B6_validate B12_time_repair B18_sentinels B24_clean_for_model C3_long_to_wide C5_repeated_groups C10_cross_tab I4_restore_union
J1_data_name J3_equipment J7_numbered_names K1_explained_variance K3_K5_t2_q_test K10_classification_statistics
L2_import_stream L4_hourly_counter L6_time_link_stream flow_linked_summary""".split()

NAMES = list(entry.queries()) if os.environ.get("MILLRACE_ALL") else SELECTION


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    _, text, good = compare(spark, duck, name, SF)
    if text.startswith("ok 0"):  # nothing to find in the smallest tables
        larger = SF.replace("sf0.001", "sf0.01")
        _, text, good = compare(spark, connect(larger), name, larger)
    assert good, text


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 250
    assert set(SELECTION) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
