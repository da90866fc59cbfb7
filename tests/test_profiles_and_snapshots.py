"""Profile-likelihood intervals against constrained refits, and snapshots whose writer dies."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitlens.operators import fits
from visitlens.operators.design import Factor, Numeric
from visitlens.operators.profiles import profile_intervals
from visitlens.sources import tables

CHI_SQUARE = {0.95: 3.841458820694124, 0.9: 2.705543454095404}


def loglik(eta, y, family):
    return float(np.sum(y * eta - (np.logaddexp(0, eta) if family == "binomial" else np.exp(eta))))


def refit(X, y, shift, family):
    beta = np.zeros(X.shape[1])
    for _ in range(100):
        eta = X @ beta + shift
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(np.minimum(eta, 30))
        weight = mu * (1 - mu) if family == "binomial" else mu
        step = np.linalg.solve(X.T @ (X * weight[:, None]) + 1e-12 * np.eye(len(beta)), X.T @ (y - mu))
        beta = beta + step * min(1.0, 2 / max(np.max(np.abs(step)), 1e-9))
        if np.max(np.abs(step)) < 1e-11:
            break
    return beta, loglik(X @ beta + shift, y, family)


def dense_end(X, y, shift, family, j, side, level):
    """Bisection on the coefficient, all others refitted at every value."""
    beta, top = refit(X, y, shift, family)
    rest = np.delete(X, j, axis=1)
    near, far = beta[j], beta[j] + side * 8
    for _ in range(60):
        middle = (near + far) / 2
        fall = 2 * (top - refit(rest, y, shift + X[:, j] * middle, family)[1])
        near, far = (middle, far) if fall < CHI_SQUARE[level] else (near, middle)
    return math.exp(near)


@pytest.mark.parametrize("family, level", [("binomial", 0.95), ("poisson", 0.9)])
def test_profile_limits_match_constrained_refits(spark, family, level):
    draw = np.random.default_rng(5)
    n = 120
    frame = pd.DataFrame({"x": np.round(draw.normal(size=n), 1), "g": draw.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "e": draw.integers(1, 4, n).astype(float)})
    X = np.column_stack([np.ones(n), frame.x, frame.g == "b", frame.g == "c"]).astype(float)
    eta = X @ np.array([-0.5, 0.8, 0.6, -0.4])
    offset, shift = (None, np.zeros(n)) if family == "binomial" else ("ln(e)", np.log(frame.e.to_numpy()))
    frame["y"] = (draw.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if family == "binomial" else draw.poisson(np.exp(eta + shift)).astype(float)
    fit = fits.fit_glm(spark.createDataFrame(frame).repartition(3), [Numeric("x"), Factor("g")], "y", family, offset)
    rows = profile_intervals(fit, spark, level).collect()
    assert [r["parameter"] for r in rows] == ["(Intercept)", "x", "gb", "gc"]
    for j, row in enumerate(rows):
        assert row["odds_ratio"] == pytest.approx(math.exp(fit.estimates[j]))
        assert row["lower"] == pytest.approx(dense_end(X, frame.y.to_numpy(), shift, family, j, -1, level), rel=1e-6)
        assert row["upper"] == pytest.approx(dense_end(X, frame.y.to_numpy(), shift, family, j, 1, level), rel=1e-6)


def test_profile_of_dependent_terms_and_blocks_of_ends(spark, monkeypatch):
    draw = np.random.default_rng(6)
    frame = pd.DataFrame({"x": draw.integers(0, 9, 200).astype(float)})
    frame["y"] = (draw.random(200) < 1 / (1 + np.exp(1 - 0.3 * frame.x))).astype(float)
    table = spark.createDataFrame(frame)
    fit = fits.fit_glm(table, [Numeric("x"), Numeric("again", "2 * x")], "y", "binomial")
    whole = profile_intervals(fit, spark).collect()
    assert whole[2]["parameter"] == "again" and whole[2]["odds_ratio"] is None and whole[2]["lower"] is None
    assert whole[1]["lower"] < whole[1]["odds_ratio"] < whole[1]["upper"]
    monkeypatch.setattr("visitlens.operators.profiles.BLOCK_BYTES", 1)
    assert profile_intervals(fit, spark).collect()[1]["lower"] == pytest.approx(whole[1]["lower"], rel=1e-9)
    with pytest.raises(ValueError):
        profile_intervals(fits.fit_linear(table, [Numeric("x")], "y"), spark)


def test_profile_end_that_does_not_exist_is_null(spark):
    """Every y of level b is one, so the likelihood only levels off as its coefficient grows."""
    rows = [("a", float(i % 2)) for i in range(20)] + [("b", 1.0)] * 8
    fit = fits.fit_glm(spark.createDataFrame(rows, "g string, y double"), [Factor("g")], "y", "binomial")
    found = {r["parameter"]: r for r in profile_intervals(fit, spark).collect()}
    assert found["gb"]["upper"] is None
    # with all of b's likelihood lost by 1.92 at the rate of level a, whose own coefficient moves along
    X, y = np.array([[1.0, r[0] == "b"] for r in rows], dtype=float), np.array([r[1] for r in rows])
    top, low, high = -20 * math.log(2), 0.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        fall = 2 * (top - refit(X[:, :1], y, X[:, 1] * middle, "binomial")[1])
        low, high = (middle, high) if fall > CHI_SQUARE[0.95] else (low, middle)
    assert found["gb"]["lower"] == pytest.approx(math.exp(low), rel=1e-5)
    assert found["(Intercept)"]["lower"] < 1 < found["(Intercept)"]["upper"]


def test_dead_writer_leaves_the_published_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    old = spark.range(100).withColumn("part", F.format_string("%02d", F.col("id") % 3))
    assert tables.published_snapshots(spark, folder, "t").count() == 0
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, folder, "t")
    tables.write_snapshot(old, folder, "t", "1", ["part"])
    # it dies while some tasks have written their files
    broken = spark.range(0, 200, 1, 8).withColumn("part", F.when(F.col("id") < 150, "00").otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        tables.write_snapshot(broken, folder, "t", "2")
    assert tables.read_snapshot(spark, folder, "t").count() == 100
    # it dies between the files and the manifest
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            tables.write_snapshot(spark.range(7), folder, "t", "2")
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, folder, "t", "2")
    back = tables.read_snapshot(spark, folder, "t")
    assert {r["part"] for r in back.select("part").distinct().collect()} == {"00", "01", "02"}
    # the same version can be written again, once
    tables.write_snapshot(spark.range(50), folder, "t", "2")
    assert tables.read_snapshot(spark, folder, "t").count() == 50 and tables.read_snapshot(spark, folder, "t", "1").count() == 100
    with pytest.raises(ValueError):
        tables.write_snapshot(spark.range(1), folder, "t", "2")


def test_empty_snapshot_keeps_its_columns(spark, tmp_path):
    tables.write_snapshot(spark.createDataFrame([], "a int, b string"), str(tmp_path), "t", "1", ["b"])
    back = tables.read_snapshot(spark, str(tmp_path), "t")
    assert back.count() == 0 and dict(back.dtypes) == {"a": "int", "b": "string"}
