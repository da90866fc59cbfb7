"""Ordered series in small blocks, residual tests on published samples, smooth lines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitlens.operators import normality, plotdata, series

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def walk():
    return np.cumsum(RNG.normal(size=700)) * 0.3 + RNG.normal(size=700)


@pytest.fixture(scope="module")
def placed(spark, walk):
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(700) * 10, "x": walk})).repartition(9)
    return series.indexed(df, ["t"]).persist()


@pytest.mark.parametrize("block", [60, 128, 100_000])
def test_difference_across_blocks(placed, walk, block):
    got = [r[0] for r in series.difference(placed, "x", "position", block=block).orderBy("position").select("difference").collect()]
    np.testing.assert_allclose(got, np.diff(walk))


@pytest.mark.parametrize("block", [50, 333, 100_000])
def test_autocorrelation_across_blocks(placed, walk, block):
    rows = series.autocorrelation(placed, "x", "position", 40, block=block).orderBy("lag").collect()
    c = walk - walk.mean()
    want = [np.sum(c[k:] * c[: 700 - k]) / np.sum(c * c) for k in range(41)]
    np.testing.assert_allclose([r["acf"] for r in rows], want, atol=1e-12)


def test_default_number_of_lags(placed):
    assert series.autocorrelation(placed, "x", "position").count() == int(10 * np.log10(700)) + 1


def test_lags_beyond_a_block_are_refused(placed):
    with pytest.raises(ValueError, match="look-back"):
        series.lags(placed, "x", "position", 20, block=10)


def test_slice(placed, walk):
    got = series.slice_rows(placed, 11, 13).orderBy("position").collect()
    np.testing.assert_allclose([r["x"] for r in got], walk[10:13])


@pytest.mark.parametrize("block", [64, 100_000])
def test_unit_root_statistic(placed, walk, block):
    order = 5
    x, y = walk, np.diff(walk)
    n, k = len(y), order + 1
    rows = np.arange(k, n + 1)
    X = np.column_stack([np.ones(len(rows)), x[rows - 1], rows, *[y[rows - 1 - j] for j in range(1, k)]])
    target = y[rows - 1]
    beta = np.linalg.lstsq(X, target, rcond=None)[0]
    sigma2 = np.sum((target - X @ beta) ** 2) / (len(rows) - X.shape[1])
    want = beta[1] / np.sqrt(np.linalg.inv(X.T @ X)[1, 1] * sigma2)
    got = normality.adf_test(placed, "x", "position", order, block).first()
    assert got["statistic"] == pytest.approx(want, rel=1e-6)


def test_unit_root_is_rejected_for_noise_only(spark, placed):
    noise = series.indexed(spark.createDataFrame(pd.DataFrame({"t": np.arange(600), "x": RNG.normal(size=600)})), ["t"])
    assert normality.adf_test(noise, "x", "position").first()["p_value"] == pytest.approx(0.01)
    walk = series.indexed(spark.createDataFrame(pd.DataFrame({"t": np.arange(600), "x": np.cumsum(RNG.normal(size=600))})), ["t"])
    row = normality.adf_test(walk, "x", "position").first()
    assert row["lag_order"] == 8 and row["p_value"] > 0.02


def test_products_of_lags_follow_from_the_first_row():
    y, first, order = RNG.normal(size=60), 13, 9
    lagged = np.stack([y[first - j:60 - j] for j in range(order + 1)])
    whole = lagged @ lagged.T
    before, last = (np.array([y[at - 1 - j] for j in range(order + 1)]) for at in (first, 60))
    np.testing.assert_allclose(normality.lag_products(whole[0], before, last), whole, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n, order", [(2, 1), (9, 2), (10, 2), (1001, 10), (1000, 9), (10**9 + 1, 1000)])
def test_default_order_is_the_whole_cube_root(n, order):
    assert normality.default_order(n) == order


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 2.0, 4.0], [float(i) for i in range(40)], [3.0] * 40])
def test_unit_root_without_an_answer(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t int, x double")
    got = normality.adf_test(series.indexed(rows, ["t"]), "x", "position").first()
    assert got["statistic"] is None and got["p_value"] is None


def test_unit_root_of_a_high_order_in_small_blocks(spark, placed, walk):
    """Blocks shorter than the look-back grow to it, and the order costs no more columns of a table."""
    whole, cut = (normality.adf_test(placed, "x", "position", 150, block).first() for block in (50_000, 160))
    assert whole["statistic"] == pytest.approx(cut["statistic"], rel=1e-7) and whole["lag_order"] == 150


SAMPLE = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_shapiro_on_published_samples(spark):
    rows = [("s", v) for v in SAMPLE] + [("w", float(v)) for v in WEIGHTS] + [("flat", 1.0)] * 5 + [("two", 1.0), ("two", 2.0)]
    got = {r["g"]: r for r in normality.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got["s"]["w"] == pytest.approx(0.900473, abs=2e-6) and got["s"]["p_value"] == pytest.approx(0.0420897, abs=2e-6)
    assert got["w"]["w"] == pytest.approx(0.79, abs=0.003) and got["w"]["p_value"] < 0.01
    assert got["flat"]["w"] is None and got["two"]["w"] is None and got["two"]["n"] == 2


def test_weighted_cells_are_tested_as_their_rows(spark):
    rows = [(g, v) for g, v in zip("ab" * 150, np.round(RNG.normal(size=300), 1).tolist())] + [("a", None), (None, 1.0)]
    table = spark.createDataFrame(rows, "g string, x double")
    cells = table.groupBy("g", "x").agg(F.count("*").cast("double").alias("w")).unionByName(spark.createDataFrame([("a", 9.0, 0.0)], "g string, x double, w double"))
    got, want = (sorted(map(tuple, f.collect()), key=repr) for f in (
        normality.shapiro_wilk(cells, ["g"], "x", "w"), normality.shapiro_wilk(table, ["g"], "x")))
    assert len(got) == 3 and [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == (pytest.approx(b[2], rel=1e-10), pytest.approx(b[3], rel=1e-8)) if b[2] is not None else a[2:] == (None, None)
    a, b = normality.ks_normal(cells, "x", "w").first(), normality.ks_normal(table, "x").first()
    assert a["n"] == b["n"] == 301 and a["statistic"] == pytest.approx(b["statistic"], rel=1e-10) and a["p_value"] == pytest.approx(b["p_value"], rel=1e-8)


def test_shapiro_without_keys_and_above_the_limit(spark):
    one = normality.shapiro_wilk(spark.createDataFrame([(v,) for v in SAMPLE], "x double"), [], "x").first()
    assert one["w"] == pytest.approx(0.900473, abs=2e-6)
    many = normality.shapiro_wilk(spark.range(5_001).select(F.col("id").cast("double").alias("x")), [], "x").first()
    assert many["n"] == 5_001 and many["w"] == pytest.approx(0.955, abs=0.002)


def test_kolmogorov_smirnov(spark):
    x = np.sort(np.array(SAMPLE))
    from statistics import NormalDist
    cdf = np.array([NormalDist(x.mean(), x.std(ddof=1)).cdf(v) for v in x])
    i = np.arange(1, len(x) + 1)
    row = normality.ks_normal(spark.createDataFrame([(v,) for v in SAMPLE], "x double"), "x").first()
    assert row["statistic"] == pytest.approx(max(np.max(i / len(x) - cdf), np.max(cdf - (i - 1) / len(x))), rel=1e-9)
    assert 0 < row["p_value"] < 1


def test_normal_quantile_points(spark):
    df = spark.createDataFrame([("a", float(v), i) for i, v in enumerate(SAMPLE)] + [("b", float(v), i) for i, v in enumerate(SAMPLE[:4])], "g string, x double, i int")
    rows = plotdata.qq_points(df, ["g"], "x", ["i"]).orderBy("g", "rank").collect()
    from statistics import NormalDist
    assert rows[0]["theoretical"] == pytest.approx(NormalDist().inv_cdf(0.5 / 20))
    assert rows[20]["theoretical"] == pytest.approx(NormalDist().inv_cdf((1 - 0.375) / 4.25))
    line = {r["g"]: r for r in plotdata.qq_line(df, ["g"], "x").collect()}
    q1, q3 = np.quantile(SAMPLE, [0.25, 0.75])
    assert line["a"]["slope"] == pytest.approx((q3 - q1) / (2 * NormalDist().inv_cdf(0.75)))


@pytest.mark.parametrize("degree", [1, 2])
def test_smooth_line_against_direct_local_fits(spark, degree):
    x = np.repeat(np.arange(1, 31), 2).astype(float)
    y = np.sin(x / 5) + RNG.normal(size=60) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    got = plotdata.loess_line(df, "g", "x", "y", 0.5, 15, degree).orderBy("x").collect()
    for r in got:
        d = np.abs(x - r["x"])
        h = np.sort(d)[int(60 * 0.5) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        beta = np.polyfit(x - r["x"], y, degree, w=np.sqrt(w))
        assert r["smooth"] == pytest.approx(beta[-1], abs=1e-6)


def test_smooth_line_keeps_a_straight_line(spark):
    df = spark.range(1, 9).select(F.lit("a").alias("g"), F.col("id").alias("x"), (F.col("id") * 2 + 1).alias("y"))
    for r in plotdata.loess_line(df, "g", "x", "y").collect():
        assert r["smooth"] == pytest.approx(2 * r["x"] + 1, abs=1e-6)


def test_box_reads_its_rows_once(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 3000), "v": np.round(rng.normal(size=3000) ** 3, 2)})
    frame.loc[:6, "g"] = None
    frame.loc[frame.index % 50 == 7, "v"] = None
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    slow = df.mapInPandas(passed, df.schema)
    for spread in (None, False, True):
        read.value = 0
        got = {r["g"]: r for r in plotdata.box_stats(slow, "g", "v", spread).collect()}
        assert read.value == len(frame)
        for g, part in frame.groupby("g", dropna=False):
            v, row = part["v"].dropna(), got[g if isinstance(g, str) else None]
            q = v.quantile([0, 0.25, 0.5, 0.75, 1]).tolist()
            reach = (q[3] - q[1]) * 1.5
            inside = v[(v >= q[1] - reach) & (v <= q[3] + reach)]
            assert [row[c] for c in ("min", "q1", "median", "q3", "max")] == pytest.approx(q, abs=1e-9)
            assert (row["whisker_low"], row["whisker_high"], row["n_beyond"]) == (inside.min(), inside.max(), len(v) - len(inside))
    assert plotdata.box_stats(df.filter("v is null"), "g", "v").count() == 0


def test_box_and_bins(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    for spread in (False, True):
        row = plotdata.box_stats(df, "g", "v", spread).first()
        assert (row["median"], row["whisker_low"], row["whisker_high"], row["n_beyond"]) == (3.5, 1.0, 5.0, 1)
    bins = {r["centre"]: r["n"] for r in plotdata.histogram(df, "v", 2.0).collect()}
    assert bins == {0.0: 1, 2.0: 2, 4.0: 2, 100.0: 1}
    assert plotdata.sturges_width(df, "v") == 20.0
    dozen = spark.createDataFrame([(float(v),) for v in range(12)], "v double")
    assert plotdata.sturges_width(dozen, "v") == 2.0
    assert [tuple(r) for r in plotdata.histogram_between(dozen, "v").orderBy("low").collect()][:2] == [(0.0, 2.0, 3), (2.0, 4.0, 2)]
