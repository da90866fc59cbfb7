"""Fits over factors of many levels: against dense solutions, and at sizes no dense matrix holds."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitlens.operators import design, fits, wide
from visitlens.operators.design import Factor, Numeric, Product, design_cells

N = 3_000
RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def frame():
    g, h = RNG.integers(0, 60, N), RNG.integers(0, 35, N)
    x, z = np.round(RNG.normal(size=N), 1) + 0.02 * g, RNG.integers(0, 4, N).astype(float)
    eta = 0.2 + 0.3 * x - 0.2 * z + RNG.normal(size=60)[g] * 0.5 + 0.4 * RNG.normal(size=35)[h]
    return pd.DataFrame({
        "g": [f"g{v:03d}" for v in g], "h": h.astype(float), "x": x, "z": z, "s": RNG.choice(["a", "b", "c"], N),
        "y": eta + RNG.normal(size=N), "b": (RNG.random(N) < 1 / (1 + np.exp(-eta))).astype(float), "c": RNG.poisson(np.exp(eta)).astype(float),
        "exposure": RNG.integers(1, 5, N).astype(float)})


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


TERMS = [Numeric("x"), Factor("g", "g007"), Factor("s"), Product(Numeric("z"), Factor("s"))]


def by_term(fit, spark):
    return {r["term"]: (r["estimate"], r["std_error"], r["statistic"], r["p_value"]) for r in fit.terms(spark).collect()}


def close(a, b, rtol):
    assert a.keys() == b.keys()
    for term in a:
        for v, w in zip(a[term], b[term]):
            assert (v is None) == (w is None), term
            if v is not None:
                assert v == pytest.approx(w, rel=rtol, abs=rtol), term


@pytest.mark.parametrize("family, response, offset", [
    ("gaussian", "y", None), ("gaussian", "y", "ln(exposure)"), ("binomial", "b", None), ("poisson", "c", None), ("poisson", "c", "ln(exposure)")])
def test_eliminated_factor_gives_the_dense_fit(spark, table, monkeypatch, family, response, offset):
    def fit():
        return fits.fit_linear(table, TERMS, response, offset) if family == "gaussian" else fits.fit_glm(table, TERMS, response, family, offset)

    dense = fit()
    monkeypatch.setattr(design, "MAX_LEVELS", 40)
    few = fit()
    assert isinstance(few, wide.WideFit)
    close(by_term(few, spark), by_term(dense, spark), 2e-5)
    a, b = (f.summary(spark).first().asDict() for f in (few, dense))
    assert a.keys() == b.keys()
    for name in a.keys() - {"iterations"}:
        assert a[name] == pytest.approx(b[name], rel=1e-6, abs=1e-9), name
    for fitted in ("link", "fitted", "residual"):
        sums = [f.predictions().agg(F.sum(F.col("_w") * F.abs(fitted) * F.col("_w"))).first()[0] for f in (few, dense)] if family != "binomial" else [0, 0]
        assert sums[0] == pytest.approx(sums[1], rel=1e-6)
    rows = table.withColumn("_offset", F.expr(offset or "0")).withColumn("g", F.when(F.col("h") == 0, "unseen").when(F.col("h") != 1, F.col("g")))
    scores = [f.score(rows).agg(F.sum("fitted"), F.count("fitted")).first() for f in (few, dense)]
    assert scores[0][1] == scores[1][1] and scores[0][0] == pytest.approx(scores[1][0], rel=1e-6)


def test_dependent_columns_are_reported_as_null(spark, table, monkeypatch):
    more = table.withColumn("of_g", F.substring("g", 2, 3).cast("double"))
    monkeypatch.setattr(design, "MAX_LEVELS", 40)
    fit = fits.fit_linear(more, [Numeric("x"), Numeric("of_g"), Factor("g"), Numeric("twice", "2 * x + of_g")], "y")
    got = by_term(fit, spark)
    assert got["of_g"] == got["twice"] == (None,) * 4 and got["x"][0] is not None
    assert fit.df_residual == N - 60 - 1


@pytest.mark.parametrize("family, response, terms", [
    ("gaussian", "y", [Numeric("x"), Factor("h", 3), Factor("g"), Product(Numeric("z"), Factor("g"))]),
    ("poisson", "c", [Factor("h"), Factor("s")])])
def test_conjugate_gradients_give_the_dense_estimates(spark, frame, monkeypatch, family, response, terms):
    few_levels = frame.assign(g=frame.g.str[2:], h=frame.h % 11)
    table = spark.createDataFrame(few_levels).coalesce(2)

    def fit():
        return fits.fit_linear(table, terms, response) if family == "gaussian" else fits.fit_glm(table, terms, response, family)

    dense = fit()
    monkeypatch.setattr(design, "MAX_LEVELS", 2 if family == "poisson" else 8)
    few = fit()
    assert few.measures["converged"] == 1.0
    a, b = by_term(few, spark), by_term(dense, spark)
    assert a.keys() == b.keys() and all(v[1] is None for v in a.values())
    np.testing.assert_allclose([a[t][0] for t in a], [b[t][0] for t in a], rtol=1e-5, atol=1e-5)


def test_sparse_rows_are_the_dense_matrix(spark, table):
    terms = [Numeric("x"), Factor("g", "g007"), Factor("h", full=True), Product(Factor("s"), Factor("g")), Product(Numeric("z"), Factor("h"))]
    cells = design_cells(table.withColumn("row", F.monotonically_increasing_id()), terms, "y", keep=["row"])
    dense = design.design_of(cells, terms)
    sparse = wide.sparse_design(cells, terms, ["row"])
    names = {r["index"]: r["name"] for r in sparse.columns.collect()}
    assert [names[i] for i in range(sparse.size)] == dense.names
    want = {r["row"]: r["xs"] for r in cells.select("row", F.array(*dense.columns.values()).alias("xs")).collect()}
    for r in sparse.rows.collect():
        full = np.zeros(sparse.size)
        full[r["_index"]] = r["_value"]
        assert full.tolist() == want[r["row"]]


def test_hundred_thousand_levels(spark):
    n, levels = 400_000, 100_000
    rows = spark.range(n).select(
        (F.col("id") % levels).alias("g"), ((F.col("id") * 7919) % 1009 / 100.0).alias("x"), F.col("id").alias("row"))
    noise = (F.pmod(F.xxhash64("row"), F.lit(2001)) - 1000) / 1000.0
    rows = rows.select("g", "x", (F.col("x") * 1.5 + F.sin(F.col("g").cast("double")) + noise).alias("y"))
    fit = fits.fit_linear(rows, [Numeric("x"), Factor("g")], "y")
    assert fit.n == n and fit.df_residual == n - levels - 1
    frame = rows.toPandas()
    inside = frame[["x", "y"]] - frame.groupby("g")[["x", "y"]].transform("mean")
    slope = (inside.x * inside.y).sum() / (inside.x**2).sum()
    sigma2 = ((inside.y - slope * inside.x) ** 2).sum() / fit.df_residual
    terms = fit.terms(spark)
    assert terms.count() == levels + 1
    x = terms.filter("term = 'x'").first()
    assert x["estimate"] == pytest.approx(slope, rel=1e-9) and x["std_error"] == pytest.approx(math.sqrt(sigma2 / (inside.x**2).sum()), rel=1e-9)
    means = frame.groupby("g")[["x", "y"]].mean()
    effect = means.y - slope * means.x
    apart = means.x[77_777] - means.x[0]
    one = terms.filter("term = 'g77777'").first()
    assert one["estimate"] == pytest.approx(effect[77_777] - effect[0], rel=1e-9)
    assert one["std_error"] == pytest.approx(math.sqrt(sigma2 * (0.25 + 0.25 + apart**2 / (inside.x**2).sum())), rel=1e-9)


def test_heavy_level_and_levels_alone(spark):
    rows = spark.range(6_000).select(
        F.when(F.col("id") < 3_000, F.lit(0)).otherwise(F.col("id")).alias("g"), (F.col("id") % 11).alias("x"), ((F.col("id") * 37) % 101).alias("y"))
    fit = fits.fit_linear(rows, [Numeric("x"), Factor("g")], "y")
    heavy = rows.filter("g = 0").toPandas()
    got = by_term(fit, spark)
    assert got["x"][0] == pytest.approx(np.polyfit(heavy.x, heavy.y, 1)[0], rel=1e-8)
    assert fit.df_residual == 6_000 - 3_001 - 1 and len(got) == 3_002
