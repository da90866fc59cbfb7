"""Tests on residuals and series: Shapiro-Wilk, Kolmogorov-Smirnov, augmented Dickey-Fuller."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, functions as F

from visitlens.functions import special
from visitlens.operators.design import independent_columns, inverse
from visitlens.operators.series import BLOCK, difference, with_halo
from visitlens.operators.sizing import durable, local_table
from visitlens.operators.skew import join_per_key, number_rows

# Royston's polynomials for the two outermost weights and for the p-value.
ROYSTON_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
ROYSTON_BEFORE_LAST = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
ROYSTON_MEAN_SMALL = [0.5440, -0.39978, 0.025054, -6.714e-4]
ROYSTON_SD_SMALL = [1.3822, -0.77857, 0.062767, -0.0020322]
ROYSTON_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
ROYSTON_SD = [-0.4803, -0.082676, 0.0030302]
ROYSTON_GAMMA = [-2.273, 0.459]

# Published critical values of the unit-root statistic with trend.
UNIT_ROOT_SIZES = [25, 50, 100, 250, 500, 100000]
UNIT_ROOT_LEVELS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
UNIT_ROOT_VALUES = [
    [-4.38, -4.15, -4.04, -3.99, -3.98, -3.96],
    [-3.95, -3.80, -3.73, -3.69, -3.68, -3.66],
    [-3.60, -3.50, -3.45, -3.43, -3.42, -3.41],
    [-3.24, -3.18, -3.15, -3.13, -3.13, -3.12],
    [-1.14, -1.19, -1.22, -1.23, -1.24, -1.25],
    [-0.80, -0.87, -0.90, -0.92, -0.93, -0.94],
    [-0.50, -0.58, -0.62, -0.64, -0.65, -0.66],
    [-0.15, -0.24, -0.28, -0.31, -0.32, -0.33],
]


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(float(c))
    return total


def _rows_of(df: DataFrame, weight: str | None) -> DataFrame:
    """Cells as the rows they stand for: every value `weight` times, next to each other; a weight below 1 gives none."""
    if weight is None:
        return df
    times = F.when(F.col(weight) >= 1, F.sequence(F.lit(1), F.col(weight).cast("long")))
    return df.withColumn("_time", F.explode(times)).drop("_time")


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, n, w, p_value) per group of 3 values or more that differ; other groups give null.

    `weight` names the number of rows a cell stands for; the test is that of the rows.
    W has the same closed form at every size. The p-value's normal approximation was fitted on sizes up to 5000 and is
    carried on beyond them. Heavy groups are ranked and joined on the balanced path.
    """
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    rows = _rows_of(rows.filter(F.col(value).isNotNull()), weight).select(*keys, F.col(value).cast("double").alias("x")).filter("x is not null")
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("_variance"), F.min("x").alias("_low"), F.max("x").alias("_high")
    )
    usable = sizes.filter((F.col("n") >= 3) & (F.col("_high") > F.col("_low")))
    ranked = number_rows(join_per_key(rows, usable, keys, "inner", match_nulls=True), keys, ["x"], "i")
    expected = special.normal_quantile_udf((F.col("i") - 0.375) / (F.col("n") + 0.25))
    scored = ranked.withColumn("m", expected)
    # The expected scores are symmetric, so the outermost two and their square sum fix all weights.
    shape = scored.groupBy(*keys).agg(
        F.sum(F.col("m") * F.col("m")).alias("_mm"),
        F.max(F.when(F.col("i") == F.col("n"), F.col("m"))).alias("_last"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("_next"),
    )
    weighed = join_per_key(scored, shape, keys, "inner", match_nulls=True)
    n, mm, last, nxt = F.col("n"), F.col("_mm"), F.col("_last"), F.col("_next")
    u = 1 / F.sqrt(n)
    a_last = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(last / F.sqrt(mm) + _polynomial(ROYSTON_LAST, u))
    a_next = nxt / F.sqrt(mm) + _polynomial(ROYSTON_BEFORE_LAST, u)
    two = n > 5
    phi = F.when(
        two, (mm - 2 * last * last - 2 * nxt * nxt) / (1 - 2 * a_last * a_last - 2 * a_next * a_next)
    ).otherwise((mm - 2 * last * last) / (1 - 2 * a_last * a_last))
    i, m = F.col("i"), F.col("m")
    weight = (
        F.when(i == n, a_last).when(i == 1, -a_last)
        .when(two & (i == n - 1), a_next).when(two & (i == 2), -a_next)
        .when(n == 3, F.lit(0.0)).otherwise(m / F.sqrt(phi))
    )
    found = weighed.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(weight * F.col("x")).alias("_b"), F.max("_variance").alias("_variance")
    ).withColumn("w", F.least(F.col("_b") * F.col("_b") / (F.col("_variance") * F.col("n")), F.lit(1.0)))
    size, log_size, y = F.col("n").cast("double"), F.ln("n"), F.ln(1 - F.col("w"))
    small = -F.ln(_polynomial(ROYSTON_GAMMA, size) - y)
    z = F.when(
        size <= 11, (small - _polynomial(ROYSTON_MEAN_SMALL, size)) / F.exp(_polynomial(ROYSTON_SD_SMALL, size))
    ).otherwise((y - _polynomial(ROYSTON_MEAN, log_size)) / F.exp(_polynomial(ROYSTON_SD, log_size)))
    exact = F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(math.sqrt(0.75))))
    tested = found.withColumn(
        "p_value", F.when(size == 3, F.greatest(exact, F.lit(0.0))).otherwise(special.normal_upper_udf(z))
    ).select(*keys, "w", "p_value")
    out = join_per_key(sizes.select(*keys, "n"), tested, keys, "left", hot=[], match_nulls=True)
    return out.drop("_all")


def ks_normal(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One-sample test against the normal with the sample's own mean and sd; `weight` as in `shapiro_wilk`."""
    rows = _rows_of(df, weight).select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    n, mean, sd = rows.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    tested = KolmogorovSmirnovTest.test(rows, value, "norm", float(mean), float(sd))
    return tested.select(F.lit(n).alias("n"), F.col("statistic"), F.col("pValue").alias("p_value"))


def default_order(n: int) -> int:
    """Steps looked back on by default: the cube root of the number of steps, cut to a whole number."""
    steps = max(n - 1, 0)
    order = round(steps ** (1 / 3))
    return order if order**3 <= steps else order - 1


def lag_sums(steps: DataFrame, order: int, first: int, level_mean: float, middle: float, block: int = BLOCK) -> np.ndarray:
    """Per lag j from 0 to `order`: sums over t >= `first` of y[t - j] times y[t], the centred level, the centred time and 1.

    `steps` has `_at` (t), `_step` (y) and `_level`. Blocks with a halo of `order` rows cost rows times order.
    """
    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        y, at = rows["_step"].to_numpy(), rows["_at"].to_numpy()
        use = np.flatnonzero(rows["_own"].to_numpy() & (at >= first))
        if not len(use):
            return pd.DataFrame({"lag": [], "s0": [], "s1": [], "s2": [], "s3": []})
        a, b = use[0], use[-1] + 1
        against = np.stack([y[a:b], rows["_level"].to_numpy()[a:b] - level_mean, at[a:b] - middle, np.ones(b - a)])
        found = np.stack([against @ y[a - j:b - j] for j in range(order + 1)])
        return pd.DataFrame({"lag": np.arange(order + 1), **{f"s{i}": found[:, i] for i in range(4)}})

    halo = with_halo(steps, "_at", order, max(block, order, 1))
    parts = halo.groupBy("_block").applyInPandas(sums, "lag int, s0 double, s1 double, s2 double, s3 double")
    rows = parts.groupBy("lag").agg(*[F.sum(f"s{i}") for i in range(4)]).orderBy("lag").collect()
    return np.array([r[1:] for r in rows], float).reshape(-1, 4)


def lag_products(row: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All products of lags i and j from those of lag 0 with j.

    Looking one step further back moves both ends of the sums: the product of the values before the first row comes in, that of the
    last ones goes.
    """
    size = len(row)
    out = np.empty((size, size))
    out[0] = row
    for i in range(size - 1):
        out[i + 1, 0] = row[i + 1]
        out[i + 1, 1:] = out[i, :-1] + before[i] * before[:size - 1] - last[i] * last[:size - 1]
    return out


def adf_test(series: DataFrame, value: str, position: str, order: int | None = None, block: int = BLOCK) -> DataFrame:
    """Unit-root test with trend: (statistic, lag_order, p_value) for an indexed series.

    The normal equations of a regression on the level, the time and `order` earlier steps are put together from sums per lag, as
    the block of the lags follows from its first row and the values at both ends. The driver gets `order` rows of sums and
    2 x `order` values. p-values outside the published table are its end points. The statistic is null where nothing is left to fit.
    """
    n = series.agg(F.max(position)).first()[0] or 0
    order = default_order(n) if order is None else order
    first = order + 1
    steps = durable(difference(series.select(position, value), value, position, "_step", block).select(
        (F.col(position) - 1).alias("_at"), "_step", (F.col(value) - F.col("_step")).alias("_level")))
    size = n - 1 - order
    if size <= order + 3:
        return local_table(series.sparkSession, [(None, order, None)], "statistic double, lag_order int, p_value double")
    used = steps.filter(F.col("_at") >= first)
    mean, middle = used.agg(F.avg("_level")).first()[0], (first + n - 1) / 2
    level, time = F.col("_level") - F.lit(mean), F.col("_at") - F.lit(middle)
    plain = used.agg(F.sum(level), F.sum(level * level), F.sum(level * time), F.sum(time * time)).first()
    sums = lag_sums(steps, order, first, mean, middle, block)
    ends = dict(tuple(r) for r in steps.filter((F.col("_at") <= order) | (F.col("_at") >= n - order)).select("_at", "_step").collect())
    lags = np.arange(order + 1)
    products = lag_products(
        sums[:, 0], np.array([ends.get(order - i, 0.0) for i in lags]), np.array([ends.get(n - 1 - i, 0.0) for i in lags]))
    # Columns: constant, level, time, lags 1 to order; the step itself is lag 0.
    p = order + 3
    gram, moments = np.empty((p, p)), np.empty(p)
    gram[:3, :3] = [[size, plain[0], 0.0], [plain[0], plain[1], plain[2]], [0.0, plain[2], plain[3]]]
    across = sums[:, [3, 1, 2]].T
    gram[:3, 3:], gram[3:, :3], gram[3:, 3:] = across[:, 1:], across[:, 1:].T, products[1:, 1:]
    moments[:3], moments[3:] = across[:, 0], products[0, 1:]
    kept = independent_columns(gram)
    if 1 not in kept:
        return local_table(series.sparkSession, [(None, order, None)], "statistic double, lag_order int, p_value double")
    inverted = inverse(gram[np.ix_(kept, kept)])
    beta = inverted @ moments[kept]
    rss = max(products[0, 0] - beta @ moments[kept], 0.0)
    at = kept.index(1)
    statistic = beta[at] / math.sqrt(rss / (size - len(kept)) * inverted[at, at]) if rss > 1e-12 * products[0, 0] else math.nan
    critical = [float(np.interp(n - 1, UNIT_ROOT_SIZES, row)) for row in UNIT_ROOT_VALUES]
    known = statistic == statistic
    p_value = float(np.interp(statistic, critical, UNIT_ROOT_LEVELS)) if known else None
    return local_table(
        series.sparkSession, [(float(statistic) if known else None, order, p_value)], "statistic double, lag_order int, p_value double"
    )
