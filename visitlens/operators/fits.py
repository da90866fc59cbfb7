"""Linear, logistic, Poisson and negative-binomial fits with their inference tables.

Only passes over the cells run on Spark; what is left on the driver is arithmetic on p × p matrices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitlens.functions import special
from visitlens.operators.design import (
    INTERCEPT, OFFSET, RESPONSE, WEIGHT, Design, Term, cross_products, design_cells, design_of, dot, independent_columns,
    find_levels, inverse as invert, working_products,
)
from visitlens.operators.sizing import durable, local_table, rows_if_small
from visitlens.operators.wide import TERMS_SCHEMA, WideFit, fit_wide


@dataclass
class Fit:
    """A fitted model; estimates of terms that depend on earlier ones are NaN."""

    design: Design
    family: str
    estimates: np.ndarray
    covariance: np.ndarray
    kept: list[int]
    df_residual: float
    n: float
    measures: dict[str, float | None]

    @property
    def names(self) -> list[str]:
        return self.design.names

    @property
    def std_errors(self) -> np.ndarray:
        errors = np.full(len(self.names), np.nan)
        errors[self.kept] = np.sqrt(np.diag(self.covariance))
        return errors

    def term_rows(self) -> list[tuple]:
        errors = self.std_errors
        statistics = self.estimates / errors
        known = ~np.isnan(statistics)
        p = np.full(len(errors), np.nan)
        if self.family == "gaussian":
            p[known] = special.t_two_sided(statistics[known], np.full(known.sum(), self.df_residual))
        else:
            p[known] = special.normal_two_sided(statistics[known])
        return [
            (name, *(None if math.isnan(v) else float(v) for v in values))
            for name, *values in zip(self.names, self.estimates, errors, statistics, p)
        ]

    def terms(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.term_rows(), TERMS_SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: size, residual degrees of freedom and the measures of the family."""
        values = {"n": float(self.n), "df_residual": float(self.df_residual), **self.measures}
        return local_table(spark, [tuple(values.values())], ", ".join(f"{k} double" for k in values))

    def link(self) -> Column:
        return self.design.linear_predictor(self.estimates) + F.col(OFFSET)

    def response(self) -> Column:
        link = self.link()
        if self.family == "binomial":
            return 1 / (1 + F.exp(-link))
        return link if self.family == "gaussian" else F.exp(link)

    def predictions(self) -> DataFrame:
        """Cells with link, fitted value and response residual; `_w` is the number of rows in the cell.

        Rows of a cell are alike in predictors and response, so a logistic fit has a residual for yes and one for no.
        """
        return self.design.rows.withColumns({"link": self.link(), "fitted": self.response()}).withColumn(
            "residual", F.col(RESPONSE) - F.col("fitted")
        )

    def score(self, df: DataFrame, response_scale: bool = True, out: str = "fitted") -> DataFrame:
        """Predictions for the rows of any table that has the model's columns and the offset column.

        A null level, and one the fit has not seen, gives null.
        """
        known = F.lit(True)
        for name, levels in self.design.levels.items():
            known = known & F.coalesce(F.col(f"`{name}`").isin(levels), F.lit(False))
        return df.withColumn(out, F.when(known, self.response() if response_scale else self.link()))


def fit_linear(df: DataFrame, terms: Sequence[Term], response: str, offset: str | None = None, **options) -> Fit | WideFit:
    """Least squares from a single cross-product pass.

    A factor of more levels than a dense matrix should hold gives a `WideFit`, whose level effects are a table.
    """
    cells = design_cells(df, terms, response, offset, **options)
    levels = find_levels(cells, terms)
    if None in levels.values():
        return fit_wide(cells, terms, "gaussian", levels)
    design = design_of(cells, terms, levels)
    y = F.col(RESPONSE) - F.col(OFFSET)
    columns = list(design.columns.values())
    whole = cross_products(design.cells, [*columns, y, F.col(RESPONSE)], F.col(WEIGHT))
    p = len(columns)
    gram, moments = whole[:p, :p], whole[:p, p]
    kept = independent_columns(gram)
    inverse = invert(gram[np.ix_(kept, kept)])
    beta = inverse @ moments[kept]
    n = gram[0, 0]
    df_residual = n - len(kept)
    rss = max(whole[p, p] - beta @ moments[kept], 0.0)
    sigma2 = rss / df_residual if df_residual > 0 else math.nan
    estimates = np.full(p, np.nan)
    estimates[kept] = beta
    total = whole[p, p] - moments[0] ** 2 / n
    rank = len(kept) - 1
    r2 = 1 - rss / total if total > 0 else math.nan
    f = (total - rss) / rank / sigma2 if rank and sigma2 > 0 else math.nan
    loglik = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.nan
    measures = {
        "sigma": math.sqrt(sigma2) if sigma2 == sigma2 else None, "r_squared": r2,
        "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_residual if df_residual > 0 else None,
        "f_statistic": f, "df_model": float(rank),
        "f_p_value": float(special.f_upper(np.array([f]), rank, df_residual)[0]) if f == f else None,
        "rss": rss, "log_likelihood": loglik, "aic": 2 * (len(kept) + 1) - 2 * loglik,
    }
    return Fit(design, "gaussian", estimates, inverse * sigma2, kept, df_residual, n, measures)


MOST_STEPS = 50


def fit_glm(df: DataFrame, terms: Sequence[Term], response: str, family: str, offset: str | None = None, **options) -> Fit | WideFit:
    """Binomial or Poisson model with its canonical link, fitted by Spark's generalised linear regression.

    A factor of more levels than a dense matrix should hold gives a `WideFit`, whose level effects are a table.
    """
    cells = design_cells(df, terms, response, offset, **options)
    levels = find_levels(cells, terms)
    if None in levels.values():
        return fit_wide(_trials(cells) if family == "binomial" else cells, terms, family, levels)
    design = design_of(cells, terms, levels)
    if family == "binomial":
        design.uncounted, design.cells = design.cells, _trials(design.cells)
    elif not options.get("to_cells", True):
        design.cells = durable(design.cells)
    columns = list(design.columns.values())
    kept = independent_columns(cross_products(design.cells, columns, F.col(WEIGHT)))
    slopes = [i for i in kept if i]
    table = VectorAssembler(inputCols=[f"x{i}" for i in slopes], outputCol="features").transform(design.matrix_table())
    model = GeneralizedLinearRegression(
        family=family, featuresCol="features", labelCol=RESPONSE, weightCol=WEIGHT, offsetCol=OFFSET,
        maxIter=MOST_STEPS, tol=1e-11,
    ).fit(table.select("features", RESPONSE, WEIGHT, OFFSET))
    estimates = np.full(len(columns), np.nan)
    estimates[0] = model.intercept
    estimates[slopes] = model.coefficients.toArray()
    fit = Fit(design, family, estimates, np.empty((0, 0)), kept, 0.0, 0.0, {})
    mu, y, w = fit.response(), F.col(RESPONSE), F.col(WEIGHT)
    variance = mu * (1 - mu) if family == "binomial" else mu
    fit.covariance = invert(cross_products(design.cells, [columns[i] for i in kept], w * variance))
    link = fit.link()
    if family == "binomial":
        # in terms of the link, which stays finite where the probability rounds to 0 or 1
        likelihood = y * link - F.greatest(link, F.lit(0.0)) - F.log1p(F.exp(-F.abs(link)))
    else:
        likelihood = y * link - mu
    fit.n, total, loglik = design.cells.agg(F.sum(w), F.sum(w * y), F.sum(w * likelihood)).first()
    if family == "poisson":
        loglik -= _gamma_sum(_counts(design.cells), special.log_gamma, special.log_gamma_udf, 1.0)
    fit.df_residual = fit.n - len(kept)
    fit.measures = {"log_likelihood": loglik, "aic": 2 * len(kept) - 2 * loglik, "mean": total / fit.n,
                    "iterations": float(model.summary.numIterations), "converged": float(model.summary.numIterations < MOST_STEPS)}
    if family == "binomial":
        fit.measures["deviance"] = -2 * loglik
    else:
        fit.measures["deviance"] = model.summary.deviance
    return fit


def _trials(cells: DataFrame) -> DataFrame:
    """Yes and no cells of equal predictors as one row: share of yes, number of trials."""
    keys = [c for c in cells.columns if c not in (RESPONSE, WEIGHT)]
    yes = F.sum(F.col(WEIGHT) * F.col(RESPONSE)) / F.sum(WEIGHT)
    return durable(cells.groupBy(*keys).agg(yes.alias(RESPONSE), F.sum(WEIGHT).alias(WEIGHT)))


def _counts(cells: DataFrame):
    """Distinct counts with their number of rows: driver arrays when few, else the table itself."""
    table = cells.groupBy(RESPONSE).agg(F.sum(WEIGHT).alias(WEIGHT))
    rows = rows_if_small(table)
    return durable(table) if rows is None else np.array([tuple(r) for r in rows], dtype=float)


def _gamma_sum(counts, function, udf, shift: float) -> float:
    """Sum of a gamma-type function of (count + shift) over all rows."""
    if isinstance(counts, np.ndarray):
        return float(np.sum(counts[:, 1] * function(counts[:, 0] + shift)))
    return counts.agg(F.sum(F.col(WEIGHT) * udf(F.col(RESPONSE) + F.lit(shift)))).first()[0]


THETA_MAXIMUM = 1e7


def fit_negative_binomial(
    df: DataFrame, terms: Sequence[Term], response: str, offset: str | None = None, max_steps: int = 60, tol: float = 1e-9,
    **options,
) -> Fit:
    """Log-linear counts with variance mu + mu²/theta, theta by maximum likelihood.

    Starts from the Poisson fit. Each step is one pass of sums for a Newton step on log(theta) and one
    weighted cross-product pass for the coefficients.
    """
    start = fit_glm(df, terms, response, "poisson", offset, **options)
    if isinstance(start, WideFit):
        raise ValueError("a negative-binomial fit is dense: lump the rare levels of its factors first")
    design, kept, n = start.design, start.kept, start.n
    columns = [list(design.columns.values())[i] for i in kept]
    counts = _counts(design.cells)
    y, w = F.col(RESPONSE), F.col(WEIGHT)

    beta = start.estimates[kept]
    mu = F.exp(dot(columns, beta) + F.col(OFFSET))
    theta = n / design.cells.agg(F.sum(w * F.pow(y / mu - 1, 2))).first()[0]
    for step in range(1, max_steps + 1):
        updated = _theta_step(design.cells, counts, mu, theta, n)
        t = F.lit(updated)
        system = working_products(
            design.cells, columns, dot(columns, beta) + F.col(OFFSET),
            weight_of=lambda eta: w * F.exp(eta) / (1 + F.exp(eta) / t),
            target_of=lambda eta: eta - F.col(OFFSET) + y * F.exp(-eta) - 1,
        )
        moved = np.linalg.solve(system[:-1, :-1], system[:-1, -1])
        change = max(abs(math.log(updated / theta)), float(np.max(np.abs(moved - beta))))
        beta, theta, mu = moved, updated, F.exp(dot(columns, moved) + F.col(OFFSET))
        if change < tol or theta >= THETA_MAXIMUM:
            break
    t = F.lit(theta)
    information = cross_products(design.cells, columns, w * mu / (1 + mu / t))
    plain = design.cells.agg(F.sum(w * (y * F.ln(mu / (t + mu)) + t * F.log1p(-mu / (t + mu))))).first()[0]
    loglik = (
        plain + _gamma_sum(counts, special.log_gamma, special.log_gamma_udf, theta)
        - _gamma_sum(counts, special.log_gamma, special.log_gamma_udf, 1.0) - n * math.lgamma(theta)
    )
    estimates = np.full(len(design.names), np.nan)
    estimates[kept] = beta
    measures = {"theta": theta, "log_likelihood": loglik, "aic": 2 * (len(kept) + 1) - 2 * loglik, "steps": float(step),
                "converged": float(change < tol or theta >= THETA_MAXIMUM)}
    return Fit(design, "negative_binomial", estimates, invert(information), kept, n - len(kept), n, measures)


def _theta_step(cells: DataFrame, counts, mu: Column, theta: float, n: float) -> float:
    """One Newton step on log(theta), which keeps it positive; Poisson-like counts drive it to the maximum."""
    y, w, t = F.col(RESPONSE), F.col(WEIGHT), F.lit(theta)
    score, curvature = cells.agg(
        F.sum(w * (F.log1p(-mu / (t + mu)) + 1 - (y + t) / (t + mu))),
        F.sum(w * (1 / t - 2 / (t + mu) + (y + t) / F.pow(t + mu, 2))),
    ).first()
    score += _gamma_sum(counts, special.digamma, special.digamma_udf, theta) - n * float(special.digamma(theta))
    curvature += _gamma_sum(counts, special.trigamma, special.trigamma_udf, theta) - n * float(special.trigamma(theta))
    slope, bend = theta * score, theta * score + theta * theta * curvature
    step = -slope / bend if bend < 0 else math.copysign(1.0, slope)
    return min(theta * math.exp(max(-2.0, min(2.0, step))), THETA_MAXIMUM)


def variance_inflation(fit: Fit, spark: SparkSession) -> DataFrame:
    """(term, gvif, df, gvif_scaled): generalised inflation from the correlation of the coefficients."""
    names = [fit.names[i] for i in fit.kept]
    inner = [i for i, name in enumerate(names) if name != INTERCEPT]
    covariance = fit.covariance[np.ix_(inner, inner)]
    scale = np.sqrt(np.diag(covariance))
    correlation = covariance / np.outer(scale, scale)
    owners = [fit.design.term_of[names[i]] for i in inner]
    whole = np.linalg.slogdet(correlation)[1]
    rows = []
    for term in dict.fromkeys(owners):
        own = [i for i, o in enumerate(owners) if o == term]
        rest = [i for i, o in enumerate(owners) if o != term]
        parts = sum(np.linalg.slogdet(correlation[np.ix_(s, s)])[1] for s in (own, rest) if s)
        value = math.exp(parts - whole)
        rows.append((term, value, len(own), value ** (1 / (2 * len(own)))))
    return local_table(spark, rows, "term string, gvif double, df int, gvif_scaled double")


def odds_table(terms: DataFrame, z: float = 1.96) -> DataFrame:
    """exp of each estimate with its Wald interval."""
    e, s = F.col("estimate"), F.col("std_error")
    return terms.select(
        F.col("term").alias("parameter"), F.exp(e).alias("odds_ratio"),
        F.exp(e - z * s).alias("lower"), F.exp(e + z * s).alias("upper"), "p_value",
    )


def linear_table(fit: Fit, spark: SparkSession, level: float = 0.95) -> DataFrame:
    """Untransformed estimates of a linear fit with their t intervals; null where a term depends on earlier ones."""
    reach = float(special.t_quantile(np.array([0.5 + level / 2]), np.array([fit.df_residual]))[0])
    rows = [
        (term, estimate, error, None if error is None else estimate - reach * error, None if error is None else estimate + reach * error, p)
        for term, estimate, error, _, p in fit.term_rows()
    ]
    return local_table(spark, rows, "term string, estimate double, std_error double, lower double, upper double, p_value double")


def prior_terms(terms: DataFrame) -> DataFrame:
    """Prior mean and scale of each term: the estimate and twice its standard error."""
    return terms.select("term", F.col("estimate").alias("mean"), (F.col("std_error") * 2).alias("scale"))


def compare_coefficients(large: DataFrame, small: DataFrame, column: str, strip: str) -> DataFrame:
    """One column of two term tables side by side, terms missing from one at 0, `strip` cut from the names."""
    from visitlens.operators.tables import full_join_suffixed

    sides = [t.select(F.regexp_replace("term", strip, "").alias("predictor"), F.col(column)) for t in (large, small)]
    return full_join_suffixed(*sides, "predictor", ("_large", "_small")).fillna(0.0)


def coefficient_differences(first: Fit, second: Fit, spark: SparkSession) -> DataFrame:
    """Difference of each shared coefficient with a Welch-type test, matched by term."""
    a = first.terms(spark).select("term", F.col("estimate").alias("estimate1"), F.col("std_error").alias("std_error1"))
    b = second.terms(spark).select("term", F.col("estimate").alias("estimate2"), F.col("std_error").alias("std_error2"))
    s1, s2 = F.col("std_error1"), F.col("std_error2")
    spread = F.sqrt(s1 * s1 + s2 * s2)
    df = F.pow(spread, 4) / (
        F.pow(s1, 4) / F.lit(first.df_residual - 1) + F.pow(s2, 4) / F.lit(second.df_residual - 1)
    )
    tested = a.join(b, "term").withColumn("difference", F.col("estimate1") - F.col("estimate2")).withColumns(
        {"t_value": F.col("difference") / spread, "df": df}
    )
    return tested.withColumn("p_value", special.t_two_sided_udf("t_value", "df"))
