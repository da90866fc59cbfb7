"""Fits against plain numpy solutions, and properties they must have."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitlens.operators import distributions, fits, forest, grouped_fits, plotdata, posterior
from visitlens.operators import smooth_and_mixed as mixed
from visitlens.operators.design import Factor, Numeric, Product, build_design

RNG = np.random.default_rng(11)
N = 2_000


@pytest.fixture(scope="module")
def frame():
    x = RNG.integers(0, 12, N).astype(float)
    z = np.round(RNG.normal(size=N), 1)
    g = RNG.choice(["a", "b", "c"], N, p=[0.5, 0.3, 0.2])
    eta = 0.3 + 0.1 * x - 0.4 * z + 0.5 * (g == "b") - 0.2 * (g == "c")
    mu = np.exp(eta)
    return pd.DataFrame({
        "id": np.arange(N), "x": x, "z": z, "g": g, "exposure": RNG.integers(1, 5, N).astype(float),
        "y": eta + RNG.normal(size=N), "p": (RNG.random(N) < 1 / (1 + np.exp(-eta + 1))).astype(float),
        "n": RNG.poisson(mu).astype(float), "nb": RNG.negative_binomial(2.0, 2.0 / (2.0 + mu)).astype(float),
        "unit": [f"u{i % 15:02d}" for i in range(N)],
    })


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


TERMS = [Numeric("x"), Numeric("z"), Factor("g")]


def matrix(frame, reference="a"):
    dummies = [(frame.g == v).astype(float) for v in "abc" if v != reference]
    return np.column_stack([np.ones(len(frame)), frame.x, frame.z, *dummies])


def estimates(fit):
    return fit.estimates, fit.std_errors


def irls(X, y, family, offset=0.0, steps=40):
    beta = np.zeros(X.shape[1])
    beta[0] = math.log(y.mean() / (1 - y.mean())) if family == "binomial" else math.log(y.mean())
    for _ in range(steps):
        eta = X @ beta + offset
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        w = mu * (1 - mu) if family == "binomial" else mu
        hessian = X.T @ (X * w[:, None])
        beta = beta + np.linalg.solve(hessian, X.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(hessian)))


def test_linear_fit_matches_least_squares(spark, frame, table):
    fit = fits.fit_linear(table, TERMS, "y")
    X, y = matrix(frame), frame.y.to_numpy()
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    sigma2 = rss[0] / (N - 5)
    np.testing.assert_allclose(fit.estimates, beta, rtol=1e-8)
    np.testing.assert_allclose(fit.std_errors, np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * sigma2), rtol=1e-8)
    assert fit.measures["r_squared"] == pytest.approx(1 - rss[0] / np.sum((y - y.mean()) ** 2))
    assert fit.names == ["(Intercept)", "x", "z", "gb", "gc"]
    assert fit.summary(spark).first()["df_residual"] == N - 5


def test_cells_or_rows_give_the_same_fit(table):
    a, b = (fits.fit_linear(table, TERMS, "y", to_cells=c) for c in (True, False))
    np.testing.assert_allclose(a.estimates, b.estimates, rtol=1e-9)


def test_reference_level_and_interaction(frame, table):
    fit = fits.fit_linear(table, [Numeric("x"), Factor("g", "c"), Product(Numeric("x"), Factor("g", "c"))], "y")
    assert fit.names == ["(Intercept)", "x", "ga", "gb", "x:ga", "x:gb"]
    X = np.column_stack([np.ones(N), frame.x, frame.g == "a", frame.g == "b", frame.x * (frame.g == "a"), frame.x * (frame.g == "b")]).astype(float)
    np.testing.assert_allclose(fit.estimates, np.linalg.lstsq(X, frame.y, rcond=None)[0], rtol=1e-7)


def test_dependent_column_is_reported_as_null(spark, table):
    fit = fits.fit_linear(table, [Numeric("x"), Numeric("x_again", "2 * x - 3"), Factor("g")], "y")
    rows = {r["term"]: r for r in fit.terms(spark).collect()}
    assert rows["x_again"]["estimate"] is None and rows["x_again"]["p_value"] is None
    assert rows["x"]["estimate"] is not None
    assert fit.df_residual == N - 4


def test_rows_with_nulls_are_deleted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 1.0), (4.0, None)], "x double, y double")
    assert fits.fit_linear(df, [Numeric("x")], "y").n == 3


def test_offset_is_fixed_at_one(frame, table):
    fit = fits.fit_linear(table, TERMS, "y", "ln(exposure)")
    beta = np.linalg.lstsq(matrix(frame), frame.y - np.log(frame.exposure), rcond=None)[0]
    np.testing.assert_allclose(fit.estimates, beta, rtol=1e-7)


@pytest.mark.parametrize("family,response,offset", [("binomial", "p", None), ("poisson", "n", None), ("poisson", "n", "ln(exposure)")])
def test_glm_matches_newton(spark, frame, table, family, response, offset):
    fit = fits.fit_glm(table, TERMS, response, family, offset)
    shift = np.log(frame.exposure.to_numpy()) if offset else 0.0
    beta, errors = irls(matrix(frame), frame[response].to_numpy(), family, shift)
    np.testing.assert_allclose(fit.estimates, beta, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(fit.std_errors, errors, rtol=1e-5)
    fitted = fit.predictions().agg(F.sum(F.col("_w") * F.col("residual"))).first()[0]
    assert abs(fitted) < 1e-4
    assert fit.df_residual == N - 5


def test_glm_aic_counts_rows_not_cells(frame, table):
    fit = fits.fit_glm(table, [Factor("g")], "p", "binomial")
    share = frame.groupby("g").p.transform("mean")
    loglik = np.sum(frame.p * np.log(share) + (1 - frame.p) * np.log(1 - share))
    assert fit.measures["aic"] == pytest.approx(6 - 2 * loglik)


def nb_loglik(frame, beta, theta):
    mu = np.exp(matrix(frame) @ beta)
    y = frame.nb.to_numpy()
    lg = np.vectorize(math.lgamma)
    return np.sum(lg(y + theta) - math.lgamma(theta) - lg(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu)))


def test_negative_binomial_is_at_its_maximum(frame, table):
    fit = fits.fit_negative_binomial(table, TERMS, "nb")
    theta = fit.measures["theta"]
    best = nb_loglik(frame, fit.estimates, theta)
    assert best == pytest.approx(fit.measures["log_likelihood"], rel=1e-9)
    assert 1.5 < theta < 2.7
    for i in range(5):
        for step in (-1e-3, 1e-3):
            moved = fit.estimates.copy()
            moved[i] += step
            assert nb_loglik(frame, moved, theta) < best
    assert nb_loglik(frame, fit.estimates, theta * 1.01) < best > nb_loglik(frame, fit.estimates, theta * 0.99)


def test_negative_binomial_with_counts_kept_on_the_cluster(table, monkeypatch):
    plain = fits.fit_negative_binomial(table, TERMS, "nb", max_steps=4)
    monkeypatch.setattr(fits, "rows_if_small", lambda df: None)
    spread = fits.fit_negative_binomial(table, TERMS, "nb", max_steps=4)
    np.testing.assert_allclose(spread.estimates, plain.estimates, rtol=1e-9)
    assert spread.measures["theta"] == pytest.approx(plain.measures["theta"], rel=1e-8)


def test_underdispersed_counts_drive_theta_up(spark):
    df = spark.range(400).select((F.col("id") % 3).cast("double").alias("x"), (F.lit(4) + F.col("id") % 2).cast("double").alias("y"))
    assert fits.fit_negative_binomial(df, [Numeric("x")], "y").measures["theta"] > 1e5


def test_inflation_is_one_for_orthogonal_columns(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("a"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("b"),
                                 F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("y"))
    got = {r["term"]: r["gvif"] for r in fits.variance_inflation(fits.fit_linear(df, [Numeric("a"), Numeric("b")], "y"), spark).collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}


def test_generalised_inflation_of_a_factor(spark, frame, table):
    fit = fits.fit_linear(table, TERMS, "y")
    got = {r["term"]: r for r in fits.variance_inflation(fit, spark).collect()}
    R = np.corrcoef(matrix(frame)[:, 1:], rowvar=False)
    det = np.linalg.det
    want = det(R[2:, 2:]) * det(R[:2, :2]) / det(R)
    assert got["g"]["gvif"] == pytest.approx(want, rel=1e-8) and got["g"]["df"] == 2
    assert got["g"]["gvif_scaled"] == pytest.approx(want ** 0.25)


def test_leverage_sums_to_the_number_of_columns(table):
    rows = plotdata.leverage(fits.fit_linear(table, TERMS, "y"))
    assert rows.agg(F.sum(F.col("n") * F.col("hat"))).first()[0] == pytest.approx(5.0)


def test_group_line_equals_its_own_linear_fit(spark, table):
    group = {r["term"]: r for r in grouped_fits.fit_by_group(table, "g", "x", "y").filter("g = 'b'").collect()}
    whole = {r["term"]: r for r in fits.fit_linear(table.filter("g = 'b'"), [Numeric("x")], "y").terms(spark).collect()}
    for term in ("(Intercept)", "x"):
        for column in ("estimate", "std_error", "statistic", "p_value"):
            assert group[term][column] == pytest.approx(whole[term][column], rel=1e-6)


def test_critical_value_has_the_right_tail(table):
    row = grouped_fits.fit_statistics(table, "g", "x", "y").first()
    assert 3.8 < row["f_critical"] < 3.9


def test_posterior_odds_are_exponentiated_quantiles(spark):
    draws = spark.range(1, 5).select(F.lit("a").alias("parameter"), F.col("id").cast("double").alias("value"))
    row = posterior.draw_odds(draws).first()
    assert row["lower"] == pytest.approx(math.exp(1.075)) and row["odds_ratio"] == pytest.approx(math.exp(2.5))


def test_flat_priors_and_no_group_effect_reproduce_the_glm(spark, frame, table):
    flat = {name: mixed.Prior(0.0, 1e4) for name in ("(Intercept)", "x", "z", "gb", "gc")}
    got = {r["parameter"]: r["estimate"] for r in mixed.fit_random_intercept_logit(
        table, TERMS, "unit", "p", flat, precision_prior=(5e5, 0.5)).collect()}
    beta, _ = irls(matrix(frame), frame.p.to_numpy(), "binomial")
    for name, value in zip(("(Intercept)", "x", "z", "gb", "gc"), beta):
        assert got[name] == pytest.approx(value, abs=2e-3)
    assert got["precision"] > 1e4


def test_strong_prior_pulls_the_estimate(table):
    tight = {"x": mixed.Prior(1.0, 1e-4)}
    loose = {"x": mixed.Prior(1.0, 1e-4, 3.0)}
    for priors, low, high in ((tight, 0.99, 1.01), (loose, 0.0, 0.3)):
        got = {r["parameter"]: r["estimate"] for r in mixed.fit_random_intercept_logit(table, [Numeric("x")], "unit", "p", priors).collect()}
        assert low < got["x"] < high


def test_group_effects_shrink_but_follow_the_truth(spark):
    effects = np.linspace(-1.5, 1.5, 12)
    unit = np.repeat(np.arange(12), 300)
    p = 1 / (1 + np.exp(-effects[unit]))
    y = (np.random.default_rng(3).random(len(unit)) < p).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"unit": [f"u{u:02d}" for u in unit], "y": y, "x": np.tile([0.0, 1.0], len(unit) // 2)}))
    got = {r["parameter"]: r["estimate"] for r in mixed.fit_random_intercept_logit(df, [Numeric("x")], "unit", "y").collect()}
    found = np.array([got[f"unitu{u:02d}"] for u in range(12)])
    assert np.corrcoef(found, effects)[0, 1] > 0.98
    assert 0.5 < got["precision"] < 4


def test_random_intercepts_agree_with_dense_newton_steps(spark):
    rng = np.random.default_rng(11)
    unit, x = rng.integers(0, 6, 900), rng.integers(0, 3, 900).astype(float)
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.4 * x - 0.5 + 0.3 * (unit - 2.5))))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"unit": unit, "x": x, "y": y}))
    rows = {r["parameter"]: r for r in mixed.fit_random_intercept_logit(df, [Numeric("x")], "unit", "y", {"x": mixed.Prior(0.2, 0.3)}).collect()}
    tau = rows["precision"]["estimate"]
    X = np.column_stack([np.ones(900), x, np.eye(6)[unit]])
    centre, weight = np.array([0, 0.2] + [0] * 6), np.array([0.01, 1 / 0.09] + [tau] * 6)
    beta = np.zeros(8)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        hessian = (X.T * (p * (1 - p))) @ X + np.diag(weight)
        beta = beta + np.linalg.solve(hessian, X.T @ (y - p) - weight * (beta - centre))
    cov = np.linalg.inv(hessian)
    for i, name in enumerate(["(Intercept)", "x", *[f"unit{u}" for u in range(6)]]):
        assert rows[name]["estimate"] == pytest.approx(beta[i], abs=1e-6)
        assert rows[name]["sd"] == pytest.approx(np.sqrt(cov[i, i]), rel=1e-5)
    expected = (0.02 + 6 - tau * np.trace(cov[2:, 2:])) / (0.02 + (beta[2:] ** 2).sum())
    assert tau == pytest.approx(expected, rel=1e-5)


def test_ten_thousand_random_intercepts(spark):
    df = spark.range(40_000).select(
        F.concat(F.lit("g"), F.col("id") % 10_000).alias("unit"), (F.col("id") % 2).cast("double").alias("x"),
        F.when(F.rand(4) < F.when(F.col("id") % 10_000 < 5_000, 0.2).otherwise(0.8), 1.0).otherwise(0.0).alias("y"))
    rows = mixed.fit_random_intercept_logit(df, [Numeric("x")], "unit", "y", tol=1e-3)
    level = rows.filter("parameter like 'unitg%'").withColumn("high", F.substring("parameter", 6, 9).cast("int") >= 5_000)
    found = {r["high"]: (r["n"], r["mean"]) for r in level.groupBy("high").agg(F.count("*").alias("n"), F.avg("estimate").alias("mean")).collect()}
    assert found[True][0] == found[False][0] == 5_000
    assert found[False][1] < -0.5 and found[True][1] > 0.5


def test_spline_follows_a_curve_and_keeps_a_line_straight(spark):
    x = np.round(np.linspace(0, 1, 1500), 3)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({
        "x": x, "w": rng.integers(0, 50, 1500).astype(float), "g": np.where(np.arange(1500) % 2, "a", "b"),
        "y": np.sin(6 * x) + 0.1 * rng.normal(size=1500)}))
    summary, parametric, fitted = mixed.fit_gam(df, [mixed.Smooth("x"), mixed.Smooth("w")], [Factor("g")], "y")
    rows = {r["smooth"]: r for r in summary.collect()}
    assert rows["x"]["edf"] > 4 and rows["w"]["edf"] < 3 and rows["x"]["r_squared"] > 0.95
    error = fitted.agg(F.sqrt(F.avg(F.pow(F.col("fitted") - F.sin(F.col("x") * 6), 2)))).first()[0]
    assert error < 0.05
    assert {r["term"] for r in parametric.collect()} == {"(Intercept)", "gb"}


def test_forest_with_three_thousand_levels(spark):
    df = spark.range(6_000).select(
        F.col("id").alias("key"), F.concat(F.lit("t"), F.col("id") % 3_000).alias("name"), (F.col("id") % 7).cast("double").alias("z"))
    model = forest.fit_forest(df, "z", "key", trees=2, depth=2)
    assert model.score(model.holdout).count() == model.holdout.count() > 0


def test_forest_finds_the_predictor_that_matters(spark):
    rng = np.random.default_rng(9)
    n = 1500
    frame = pd.DataFrame({"id": np.arange(n), "who": np.arange(n) % 40, "strong": rng.integers(0, 10, n).astype(float),
                          "noise": rng.integers(0, 10, n).astype(float), "kind": rng.choice(["a", "b"], n)})
    frame["y"] = frame.strong * 2 + (frame.kind == "a") + rng.normal(size=n)
    fit = forest.fit_forest(spark.createDataFrame(frame), "y", "id", exclude=["who"], trees=15, depth=5)
    rows = {r["predictor"]: r for r in forest.forest_importance(fit, "id").collect()}
    assert set(rows) == {"strong", "noise", "kind"}
    assert rows["strong"]["mse_increase"] > 10 * abs(rows["noise"]["mse_increase"])
    assert rows["strong"]["impurity"] > 0.8
    assert forest.forest_fit(fit).first()["variance_explained"] > 0.7
    assert [r["predictor"] for r in forest.ranked_importance(forest.forest_importance(fit, "id")).collect()][0] == "strong"


def test_forest_reads_and_scores_its_rows_once(spark, monkeypatch):
    n = 1200
    df = spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 9).alias("who"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
        (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 * 2).cast("double").alias("y"))
    read, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(counter):
        def passed(batches):
            for batch in batches:
                counter.add(len(batch))
                yield batch

        return passed

    fit = forest.fit_forest(df.mapInPandas(counting(read), df.schema), "y", "key", exclude=["who"], trees=3, depth=3)
    held = fit.holdout.count()
    score = fit.score
    monkeypatch.setattr(fit, "score", lambda rows: score(rows.mapInPandas(counting(scored), rows.schema)))
    got = {r["predictor"]: r for r in forest.forest_importance(fit, "key").collect()}
    assert set(got) == {"kind", "x"} and got["x"]["mse_increase"] > 1
    assert read.value == n
    assert scored.value == held * 3


def test_lognormal_and_poisson_families_rank_as_they_should(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(200) % 5 * 1.0, "count": rng.poisson(30, 200)}))
    rows = {r["model"]: r["aic_comparable"] for r in distributions.compare_aic(df, "count", [Numeric("x")], "0").collect()}
    assert rows["Poisson"] < rows["Pareto"] and rows["Poisson"] <= rows["Negative Binomial"] + 0.5


def test_design_has_one_cell_per_distinct_combination(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)] * 4 + [("b", 1.0, 2.0), (None, 1.0, 2.0)], "g string, x double, y double")
    design = build_design(df, [Factor("g"), Numeric("x")], "y")
    assert sorted((r["g"], r["_w"]) for r in design.cells.collect()) == [("a", 4.0), ("b", 1.0)]


def test_dense_design_refuses_many_levels(spark):
    with pytest.raises(ValueError, match="levels"):
        build_design(spark.range(5_000).select(F.col("id").cast("string").alias("g"), F.lit(1.0).alias("y")), [Factor("g")], "y")
