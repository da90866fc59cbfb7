"""Null rules, bins, recodes and the rules that are easy to get wrong, on small literal tables."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from visitlens.functions import scalars as S
from visitlens.operators import levels, summaries, tables, visits
from visitlens.plans import cohort, diagnosis, rates, severity


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_membership_never_null(spark):
    assert values(spark, S.is_in(F.col("x"), [1, 2]), [1, 3, None], "x int") == [True, False, False]
    assert values(spark, S.not_in(F.col("x"), [1, 2]), [1, 3, None], "x int") == [False, True, True]


def test_two_way_choice_keeps_null_but_rules_do_not(spark):
    assert values(spark, S.if_else(F.col("x") == 1, "a", "b"), [1, 2, None], "x int") == ["a", "b", None]
    assert values(spark, S.first_match([(F.col("x") == 1, "a")], "b"), [1, 2, None], "x int") == ["a", "b", "b"]


def test_age_bins(spark):
    got = values(spark, S.age_group(F.col("x")), [0.0, 17.0, 17.5, 65.0, 65.5, None], "x double")
    assert got == ["0-17", "0-17", "18-65", "18-65", "65+", "NA"]


def test_coma_scale_bins(spark):
    got = values(spark, S.gcs_group(F.col("x")), [2.0, 3.0, 8.0, 9.0, 12.0, 13.0, 15.0, 16.0, None], "x double")
    assert got == [None, "GCS 3-8", "GCS 3-8", "GCS 9-12", "GCS 9-12", "GCS 13-15", "GCS 13-15", None, None]


def test_sex_codes(spark):
    assert values(spark, S.sex_label(F.col("x")), ["1", "2", "3", "4", "9", None], "x string") == ["male", "female", "male", "female", None, None]


def test_recode_sends_null_to_default_and_marker_to_null(spark):
    got = values(spark, S.recode_exact(F.col("x"), {"a": "A"}, "Unknown", "NA"), ["a", "b", "NA", None], "x string")
    assert got == ["A", "Unknown", None, "Unknown"]


def test_response_counts_negative_gaps_and_never_null(spark):
    day = datetime(2012, 5, 1)
    rows = [(day, datetime(2012, 7, 30)), (day, datetime(2012, 7, 30, 0, 0, 1)), (day, datetime(2012, 4, 1)), (day, None), (None, day)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    assert [r[0] for r in df.select(S.within_days(F.col("a"), F.col("b"))).collect()] == [1, 0, 1, 0, 0]


def test_calendar(spark):
    got = values(spark, S.month_ordinal(F.col("x")), [date(2009, 12, 31), date(2010, 1, 1), date(2023, 12, 31), date(2024, 1, 1), None], "x date")
    assert got == [None, 1, 168, None, None]
    assert spark.range(1).select(F.size(S.month_sequence())).first()[0] == 168
    assert values(spark, S.quarter_label(F.col("x")), [date(2010, 4, 1)], "x date") == ["2010-Q2"]


def test_code_match_is_unanchored_and_dot_matches_anything(spark):
    got = values(spark, S.contains_any_code(F.col("x"), ["S06.1", "T04"]), ["a S06.1 b", "S0611", "T0", None], "x string")
    assert got == [True, True, False, None]


def test_numbers_from_text(spark):
    assert values(spark, S.as_number(F.col("x")), ["1.5", "x", "", None], "x string") == [1.5, None, None, None]


def test_region_class_and_exposure(spark):
    codes = [Decimal("0"), Decimal("1"), Decimal("1.5"), Decimal("8"), None]
    assert values(spark, S.region_class(F.col("x")), codes, "x decimal(4,1)") == ["Other", "Capital", "Surrounding Area", "Other", None]
    assert values(spark, S.exposure(F.col("x"), F.lit(5.0)), codes, "x decimal(4,1)") == [100000.0, 5.0, 5.0, 5.0, 5.0]


def test_rare_levels_keep_null_and_use_the_given_label(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)], "x string")
    assert sorted(str(r[0]) for r in summaries.lump_rare(df, "x", 2).collect()) == [">50", "None", "a", "a", "a"]
    assert sorted(str(r[0]) for r in df.select(summaries.keep_levels(F.col("x"), ["b"])).collect()) == [">50", ">50", ">50", "None", "b"]


def test_null_profile_is_empty_without_nulls(spark):
    assert summaries.null_profile_long(spark.createDataFrame([(1, 2)], "a int, b int")).count() == 0
    got = summaries.null_profile_long(spark.createDataFrame([(1, None), (2, 3)], "a int, b int")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0), ("b", 1)]


def test_first_rule_wins(spark):
    rules = spark.createDataFrame([("x", "home", 3), ("x", "traffic", 1), ("y", "home", 3)], "value string, result string, priority int")
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "place string")
    got = tables.first_rule(df, F.col("place"), rules, "out", "unknown").orderBy("place").collect()
    assert [r["out"] for r in got] == ["unknown", "traffic", "home", "unknown"]


def test_anti_lookup_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    listed = spark.createDataFrame([("a",)], "v string")
    assert sorted(str(r[0]) for r in tables.drop_listed(df, F.col("x"), listed, "v").collect()) == ["None", "b"]


def test_last_flag_wins_and_names_are_cleaned(spark):
    rows = [('[12] "Ward A"', 1, None, 1), ('[3] "Ward B"', 0, 1, None), ("Ward C", None, None, None)]
    matrix = spark.createDataFrame(rows, "NAME string, ICU int, ER int, Other int")
    matrix = matrix.withColumn("NAME", S.clean_department(F.col("NAME")))
    got = {tuple(r) for r in tables.flag_matrix_to_map(matrix, "NAME", ["ICU", "ER", "Other"]).collect()}
    assert got == {("Ward A", "Other"), ("Ward B", "ER")}


def test_care_path_first_category(spark):
    matrix = spark.createDataFrame([("a", 1, None, None), ("b", None, 1, None), ("r", None, None, 1)], "NAME string, ICU int, ER int, Rehabilitation int")
    rows = [("b; a",), ("r;a",), ("zz; a",), (None,), ("",)]
    df = spark.createDataFrame(rows, "care_path string").withColumn("was", F.col("care_path"))
    got = {r["was"]: r["care_path"] for r in cohort.categorise_care_path(df, matrix).collect()}
    assert got == {"b; a": "ER", "r;a": "Uncategorized", "zz; a": "Uncategorized", None: "Uncategorized", "": "Uncategorized"}


def test_missing_flags_follow_null_rules(spark):
    df = spark.createDataFrame([("x", "Unknown", None, None), (None, "Work", "Unknown", "p")], "gcs_group string, cause string, arrival string, care_path string")
    got = [tuple(r) for r in cohort.missing_flags(df).select("missing_gcs", "missing_cause", "missing_arrival", "missing_care_path").collect()]
    assert got == [(0, 1, None, 1), (1, 0, 1, 0)]


def test_numbering_before_the_filter_and_maximum_after(spark):
    rows = [(1, date(2010, 1, d), d, g) for d, g in ((1, 1), (2, 0), (3, 1), (4, 0))]
    df = spark.createDataFrame(rows, "patient_id int, visit_date date, ingest_key int, gender int")
    got = visits.numbered_with_maximum(df, "patient_id", ["visit_date", "ingest_key"], F.col("gender") != 0, "n", "top")
    assert sorted((r["n"], r["top"]) for r in got.collect()) == [(1, 3), (3, 3)]


def test_first_visit_breaks_ties_by_the_ingest_key(spark):
    rows = [(1, date(2010, 1, 1), 9, "late"), (1, date(2010, 1, 1), 2, "early"), (2, date(2010, 1, 2), 5, None)]
    df = spark.createDataFrame(rows, "patient_id int, visit_date date, ingest_key int, note string")
    got = {r["patient_id"]: r["note"] for r in visits.first_visits(df, "patient_id", ["visit_date", "ingest_key"]).collect()}
    assert got == {1: "early", 2: None}


def test_grid_is_complete_and_zero_filled(spark):
    counts = spark.createDataFrame([(2010, "a", 3), (2011, "b", 1)], "year int, region string, count long")
    got = {tuple(r) for r in tables.zero_fill_grid(counts, "year", "region", "count").select("year", "region", "count").collect()}
    assert got == {(2010, "a", 3), (2010, "b", 0), (2011, "a", 0), (2011, "b", 1)}


def test_letters_by_year_fills_zero_and_skips_excluded_visits(spark):
    rows = [(2010, 1, 1, "S01", "T02"), (2010, 0, 1, "S01", "-"), (2011, 1, 1, "-", "-"), (2011, 2, None, "X1", "S2"), (2012, 0, 1, "S1", "-")]
    df = spark.createDataFrame(rows, "year int, gender int, urgency int, a string, b string")
    got = {tuple(r) for r in diagnosis.letters_by_year(df, ["a", "b"]).collect()}
    assert got == {(y, f"{c}_total", n) for y, c, n in
                   ((2010, "S", 1), (2010, "T", 1), (2010, "X", 0), (2011, "S", 0), (2011, "T", 0), (2011, "X", 0))}


def test_level_dictionary_moves_the_reference_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    got = {r["level"]: r["code"] for r in levels.level_dictionary(df, "x", "c").collect()}
    assert got == {"c": 1, "a": 2, "b": 3}


def test_level_dictionary_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(levels, "rows_if_small", lambda df: None)
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    assert {r["level"]: r["code"] for r in levels.level_dictionary(df, "x", "b").collect()} == {"b": 1, "a": 2, "c": 3}


def test_columns_by_pattern_ignore_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ICD1 int, icd2 int, other int")
    assert tables.columns_matching(df, "icd.*") == ["ICD1", "icd2"]


def test_full_join_suffixes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "t string, v int")
    b = spark.createDataFrame([("y", 5), ("z", 6)], "t string, v int")
    got = {tuple(r) for r in tables.full_join_suffixed(a, b, "t", ("_l", "_s")).collect()}
    assert got == {("x", 1, None), ("y", 2, 5), ("z", None, 6)}


def test_rates_do_not_depend_on_row_order_and_double_with_the_rows(spark):
    from checks import adapters as A
    d = "/root/testdata/sf0.001"
    v, p = A.visits(spark, d), A.population(spark, d)
    once = {tuple(r[:3]) for r in rates.region_year_rates(v, p).collect()}
    assert once == {tuple(r[:3]) for r in rates.region_year_rates(v.repartition(13, "severity"), p).collect()}
    twice = {tuple(r[:3]) for r in rates.region_year_rates(v.unionByName(v), p).collect()}
    assert twice == {(y, r, 2 * n) for y, r, n in once}


def test_severity_does_not_depend_on_partitioning(spark):
    from checks import adapters as A
    d = "/root/testdata/sf0.001"
    v, p = A.visits(spark, d), A.population(spark, d)
    order = ["visit_date", "ingest_key"]
    a = severity.severity_table(v, p, order)
    b = severity.severity_table(v.repartition(7, "severity"), p, order)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
