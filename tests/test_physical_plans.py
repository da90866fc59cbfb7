"""The physical plans must be the ones meant: pruned scans, combined aggregates, no all-pairs joins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import adapters as A
from visitlens.operators import skew, summaries, visits
from visitlens.plans import diagnosis, rates, severity

FOLDER = "/root/testdata/sf0.001"
ORDER = ["visit_date", "ingest_key"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_read_only_what_they_count(spark):
    text = plan(rates.counts_by_region_year(A.visits(spark, FOLDER)))
    assert "o_totalprice" not in text and "c_mktsegment" not in text and "o_orderpriority" not in text
    assert text.count("HashAggregate") >= 2 and "Window" not in text


def test_filters_reach_the_scan(spark):
    kept = A.visits(spark, FOLDER).filter(F.col("ingest_key") > 100)
    assert "GreaterThan(o_orderkey,100)" in plan(kept)


def test_first_visits_need_no_window(spark):
    text = plan(visits.first_visits(A.visits(spark, FOLDER), "patient_id", ORDER))
    assert "Window" not in text and "partial_min_by" in text


def test_severity_table_shuffles_visits_once_for_the_window(spark):
    table = severity.severity_table(A.visits(spark, FOLDER), A.population(spark, FOLDER), ORDER)
    text = plan(table)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "RangePartitioning" not in text and "rangepartitioning" not in text


def test_heavy_patients_are_range_partitioned_and_made_durable(spark):
    v = A.visits(spark, FOLDER)
    hot = [r[0] for r in v.select(F.xxhash64("patient_id")).distinct().limit(3).collect()]
    text = plan(skew.number_rows(v, ["patient_id"], ORDER, "i", hot=hot))
    assert "Scan ExistingRDD" in text and "Union" in text


def test_letters_are_counted_in_one_pass(spark):
    table = diagnosis.letter_totals(A.diagnosed_visits(spark, FOLDER), A.DX_SLOTS)
    assert plan(table).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", [
    "region_year_rates", "region_year_rates_filled", "severity_table", "icd_trend_report", "cohort_build", "model_tables",
    "join_back_group_agg", "rare_level_lump", "augment_by_group", "qq_points", "box_stats", "draw_summary", "cross_grid",
])
def test_no_all_pairs_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_samples_keep_only_candidates(spark):
    text = plan(summaries.sample_n(A.visits(spark, FOLDER), "ingest_key", 20, 1))
    assert "md5" in text and "TakeOrderedAndProject" in text and " < " in text
