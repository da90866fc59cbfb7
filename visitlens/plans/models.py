"""Whole analyses: the logistic ladder on the cohort, the rate model, the severity models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitlens.functions import fixed_values as fixed
from visitlens.functions.special import f_quantile
from visitlens.operators import smooth_and_mixed as mixed
from visitlens.operators.design import WEIGHT, Factor, Numeric, Product, Term
from visitlens.operators.fits import (
    Fit, coefficient_differences, fit_glm, fit_linear, fit_negative_binomial, linear_table, odds_table, prior_terms, variance_inflation,
)
from visitlens.operators.normality import ks_normal, shapiro_wilk
from visitlens.operators.sizing import durable
from visitlens.operators.summaries import pseudo_r2, rmse, sample_n
from visitlens.plans.rates import bias

COHORT_FACTORS = ["postalcode", "age_group", "sex", "arrival", "cause", "place", "missing_gcs"]
STAY = Numeric("stay_hours")


@dataclass
class Report:
    """A fit with the tables read off it: odds ratios of a logistic fit, t intervals of a linear one."""

    fit: Fit
    terms: DataFrame
    intervals: DataFrame
    inflation: DataFrame


def report(fit: Fit, spark: SparkSession) -> Report:
    terms = fit.terms(spark)
    intervals = linear_table(fit, spark) if fit.family == "gaussian" else odds_table(terms)
    return Report(fit, terms, intervals, variance_inflation(fit, spark))


def cohort_terms(*, drop: Sequence[str] = (), add: Sequence[str] = ()) -> list[Term]:
    """The cohort predictors as model terms, some left out or added."""
    return [*[Factor(c) for c in [*COHORT_FACTORS, *add] if c not in drop], STAY]


def logit_ladder(steps: Mapping[str, tuple[DataFrame, Sequence[Term]]], response: str = "response") -> dict[str, Report]:
    """One logistic model per step, each with its odds ratios and inflation factors."""
    return {
        name: report(fit_glm(table, terms, response, "binomial"), table.sparkSession)
        for name, (table, terms) in steps.items()
    }


def cohort_ladder(large: DataFrame, small: DataFrame, refined_large: DataFrame, refined_small: DataFrame) -> dict[str, Report]:
    """All predictors; three arrivals; without cause; without place; the last on the small table, and with care path."""
    tables = {k: durable(t) for k, t in {"large": large, "refined": refined_large, "small": refined_small}.items()}
    lean = {"drop": ["cause", "place"]}
    return logit_ladder({
        "all": (tables["large"], cohort_terms()),
        "three_arrivals": (tables["refined"], cohort_terms()),
        "no_cause": (tables["refined"], cohort_terms(drop=["cause"])),
        "no_place": (tables["refined"], cohort_terms(**lean)),
        "small": (tables["small"], cohort_terms(**lean)),
        "care_path": (tables["small"], cohort_terms(**lean, add=["care_path"])),
    })


def random_intercept_model(table: DataFrame, informed_by: Report, df: float = 3.0) -> DataFrame:
    """Random postcode intercepts, the other effects informed by an earlier fit."""
    family = F.when(F.col("term") == "(Intercept)", "normal").otherwise("t")
    rows = prior_terms(informed_by.terms).filter("mean is not null and scale > 0").select(
        "term", family.alias("family"), "mean", "scale", F.lit(df).alias("df")
    )
    terms = cohort_terms(drop=["cause", "place", "postalcode"])
    return mixed.fit_random_intercept_logit(table, terms, "postalcode", "response", rows)


RATE_OFFSET = "ln(population)"


def rate_terms(reference: str = "1") -> list[Term]:
    return [Numeric("year_since"), Factor("region", reference)]


@dataclass
class RateReport:
    all_visits: Report
    first_visits: Report
    differences: DataFrame
    bias: DataFrame
    r_squared: DataFrame
    normality: DataFrame
    distance_from_normal: DataFrame


def rate_report(rates: DataFrame, rates_first: DataFrame, reference: str = "1") -> RateReport:
    """Log-linear model of the rates on all and on first visits, their difference, bias and residual tests."""
    spark = rates.sparkSession
    known, known_first = (t.filter("population is not null") for t in (rates, rates_first))
    whole, first = (
        report(fit_linear(t, rate_terms(reference), "log_count", RATE_OFFSET), spark) for t in (known, known_first)
    )
    scored = whole.fit.score(known.withColumn("_offset", F.expr(RATE_OFFSET)), out="link")
    residuals = whole.fit.predictions()
    counted = scored.withColumn("predicted", F.exp("link"))
    return RateReport(
        whole, first, coefficient_differences(whole.fit, first.fit, spark), bias(scored, "link"),
        pseudo_r2(counted, "count", "predicted"), shapiro_wilk(residuals, [], "residual", WEIGHT), ks_normal(residuals, "residual", WEIGHT),
    )


def severity_terms(interaction: bool = False, age: str | None = "age_group") -> list[Term]:
    """Year, age group, gender, urgency, region class, log population and patient maximum."""
    crossed = [Product(Numeric("year_since"), Numeric("urgency"))] if interaction else []
    ages = [Factor(age)] if age else []
    return [Numeric("year_since"), Numeric("urgency"), *ages, Factor("gender"), Factor("region3"),
            Numeric("log_population", "ln(exposure)"), Numeric("patient_maximum"), *crossed]


@dataclass
class SeverityReport:
    trend: Fit
    sampled_trend: Fit
    main: Fit
    interaction: Fit
    negative_binomial: Fit
    linear_by_region: Fit
    poisson_by_region: Fit
    errors: DataFrame
    smooths: DataFrame


def severity_report(table: DataFrame, key: str, sample_size: int, seed: int = 123, age: str | None = "age_group") -> SeverityReport:
    """The severity models on one table, made durable once for all of them."""
    table = durable(table)
    by_region = [Numeric("year"), Factor("region"), Numeric("log_population", "ln(exposure)")]
    linear, poisson = fit_linear(table, by_region, "severity"), fit_glm(table, by_region, "severity", "poisson")
    scored = table.withColumn("_offset", F.lit(0.0)).withColumn("log_population", F.ln("exposure"))
    scored = poisson.score(linear.score(scored, out="linear"), out="poisson")
    y = F.col("severity")
    errors = scored.agg(rmse(y, F.col("linear")).alias("linear"), rmse(y, F.col("poisson")).alias("poisson"),
                        F.avg((y == 0).cast("double")).alias("share_zero"))
    smooths = [mixed.Smooth("year"), mixed.Smooth("log_population", "ln(exposure)")]
    return SeverityReport(
        trend=fit_linear(table, [Numeric("year")], "severity"),
        sampled_trend=fit_linear(sample_n(table, key, sample_size, seed), [Numeric("year")], "severity"),
        main=fit_linear(table, severity_terms(age=age), "severity"),
        interaction=fit_linear(table, severity_terms(True, age), "severity"),
        negative_binomial=fit_negative_binomial(table, severity_terms(age=age), "severity"),
        linear_by_region=linear, poisson_by_region=poisson, errors=errors,
        smooths=mixed.fit_gam(table, smooths, [Factor("region")], "severity")[0],
    )


def critical_trend(fit: Fit, level: float = fixed.SIGNIFICANCE) -> dict[str, float]:
    """The F statistic of a fit beside its critical value."""
    model, rest = fit.measures["df_model"], fit.df_residual
    return {"f_statistic": fit.measures["f_statistic"], "f_critical": float(f_quantile(1 - level, model, rest))}
