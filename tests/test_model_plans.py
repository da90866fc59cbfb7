"""The whole analyses run from the registry to the reports."""

import pytest
from pyspark.sql import functions as F

from checks import adapters as A, composites as CO, joins_and_aggregates as J
from visitlens.functions import scalars as S
from visitlens.plans import cohort as C, models as P, rates as R

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    large, small = C.model_tables(CO.pathed(spark, FOLDER))
    refined = C.refine_for_models(large, small, ["101", "104", "110", ">50"])
    return large, small, *refined


@pytest.fixture(scope="module")
def ladder(tables):
    return P.cohort_ladder(*tables)


def test_ladder_drops_terms_step_by_step(ladder):
    used = {name: set(r.fit.design.term_of.values()) - {"(Intercept)"} for name, r in ladder.items()}
    assert used["no_cause"] == used["three_arrivals"] - {"cause"}
    assert used["no_place"] == used["no_cause"] - {"place"}
    assert used["care_path"] == used["small"] | {"care_path"}
    assert ladder["all"].fit.n >= ladder["three_arrivals"].fit.n > ladder["small"].fit.n


def test_ladder_reports_every_term(ladder):
    for r in ladder.values():
        assert r.terms.count() == r.intervals.count() == len(r.fit.names)
        assert {x["term"] for x in r.inflation.collect()} <= set(r.fit.design.term_of.values())
        assert all(x["gvif"] > 0.99 for x in r.inflation.collect())


def test_fewer_predictors_never_fit_better(ladder):
    loglik = [ladder[k].fit.measures["log_likelihood"] for k in ("three_arrivals", "no_cause", "no_place")]
    assert loglik == sorted(loglik, reverse=True)


def test_random_intercepts_after_the_ladder(tables, ladder):
    # The unrefined table still has several postcodes; the refined one is all lumped at this size.
    rows = {r["parameter"]: r for r in P.random_intercept_model(tables[0], ladder["all"]).collect()}
    assert rows["precision"]["estimate"] > 0
    assert sum(name.startswith("postalcode") for name in rows) > 2


def test_rate_report(spark):
    v, p = A.visits(spark, FOLDER), A.population(spark, FOLDER)
    report = P.rate_report(R.region_year_rates(v, p), R.region_year_rates_first(v, p, J.ORDER))
    assert report.bias.count() == 34 and report.differences.count() == 6
    assert 0 < report.r_squared.first()["r_squared"] < 1
    assert 0 < report.normality.first()["w"] <= 1 and report.distance_from_normal.first()["n"] == 34
    slope = next(r for r in report.all_visits.intervals.collect() if r["term"] == "year_since")
    assert slope["lower"] < slope["estimate"] < slope["upper"]  # of the estimate itself, not its exponential


def test_severity_report(spark):
    table = J.severity(spark, FOLDER).withColumn("age_group", S.age_group(F.col("age")))
    report = P.severity_report(table, "ingest_key", 650)
    assert report.trend.n == 7804 and report.sampled_trend.n == 650
    assert report.interaction.measures["r_squared"] >= report.main.measures["r_squared"]
    assert len(report.interaction.names) == len(report.main.names) + 1
    errors = report.errors.first()
    assert errors["linear"] == pytest.approx(errors["poisson"], rel=0.01) and 0 < errors["share_zero"] < 1
    critical = P.critical_trend(report.trend)
    assert 3.84 < critical["f_critical"] < 3.85
    assert report.smooths.count() == 2
