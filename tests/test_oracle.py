"""Every registered query beside its SQL in DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

# One or more of every group; ORACLE_ALL=1 runs every registered query (several minutes).
USUAL = """scan_lookup sink_snapshot samples_io profile_shape select_by_pattern filter_not_in filter_code_match position_where
join_left_2key join_back_group_agg join_full_suffix zero_fill_grid map_lookup index_lookup crosstab_2way null_profile_long
rare_level_lump summary_table draw_summary visit_number first_per_key group_max_window diff_lag1 acf sample_n expand_prefix_counts
flag_matrix_to_map f_within_days f_month_ordinal f_case_match cohort_build missing_flags carepath_categorise model_tables eda_refine
region_year_rates region_year_rates_first region_year_rates_filled severity_table icd_letter_totals icd_letter_by_year
ols ols_by_group augment_by_group poisson_glm shapiro_wilk ks_normal bars_share_facet box_stats loess_line leverage_cooks""".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ORACLE_ALL") else USUAL)
def test_query(spark, duck, name):
    problem, _, _ = compare(name, QUERIES[name], ORACLES.get(name), spark, duck, FOLDER)
    assert problem is None
