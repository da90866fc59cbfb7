"""The tables behind the figures; drawing them is left to the reader's tool."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.functions import special
from visitlens.operators.design import WEIGHT
from visitlens.operators.fits import Fit
from visitlens.operators.sizing import durable, scalar, small_table
from visitlens.operators.skew import join_per_key, number_rows
from visitlens.operators.summaries import LONGEST_BRACKET, counted_quantiles, cumulative_counts, quantiles


def stacked_counts(df: DataFrame, x: str, fill: str) -> DataFrame:
    return df.groupBy(x, fill).agg(F.count(F.lit(1)).alias("n"))


def stacked_shares(df: DataFrame, x: str, fill: str, facets: Sequence[str] = ()) -> DataFrame:
    """Share of each fill level inside x and the facets; the window runs over counts, not rows."""
    counts = df.groupBy(x, fill, *facets).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(x, *facets))
    return counts.withColumn("share", F.col("n") / whole)


def facet_shares(df: DataFrame, variables: Sequence[str], fill: str, facets: Sequence[str]) -> DataFrame:
    """The faceted shares of many x variables in one long table, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    counts = (
        df.select(*facets, fill, F.inline(pairs))
        .groupBy("variable", "level", *facets, fill).agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy("variable", "level", *facets))
    return counts.withColumn("share", F.col("n") / whole)


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in bins centred on multiples of the width and closed on the right, with their share."""
    x = F.col(value).cast("double")
    number = F.ceil((x - width / 2) / width)
    bins = df.filter(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.select(
        (F.col("bin") * width).cast("double").alias("centre"), "n", (F.col("n") / scalar(bins, F.sum("n"))).alias("share")
    )


def sturges_width(df: DataFrame, value: str) -> float:
    """Bin width by Sturges' rule, brought to the near one of 1, 2, 5 and 10 times a power of ten.

    A larger step is taken when it lies less far above the rough width than the next smaller one lies below, gaps below
    counting 1.5 fold, and 2.75 fold for the step to 5.
    """
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n or high <= low:
        return 1.0
    rough = (high - low) / math.ceil(math.log2(n) + 1)
    power = 10.0 ** math.floor(math.log10(rough))
    width = power
    for step, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if step * power - rough < bias * (rough - width):
            width = step * power
    return width


def histogram_between(df: DataFrame, value: str, width: float | None = None) -> DataFrame:
    """Counts in bins between multiples of the width, closed on the right, the lowest one on the left too.

    Without a width Sturges' rule chooses it.
    """
    width = sturges_width(df, value) if width is None else width
    x = F.col(value).cast("double")
    lowest = scalar(df, F.floor(F.min(x) / width))
    number = F.greatest(F.ceil(x / width), lowest + 1)
    bins = df.filter(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.select(((F.col("bin") - 1) * width).cast("double").alias("low"), (F.col("bin") * width).cast("double").alias("high"), "n")


def box_stats(df: DataFrame, group: str, value: str, spread: bool | None = None) -> DataFrame:
    """Quartiles per group, whisker ends (furthest values within 1.5 box lengths) and values beyond them.

    The rows are read once and become distinct values per group with their counts. `spread` ranks these without holding
    a group in one task; by default where a group has more than `LONGEST_BRACKET` of them.
    """
    rows = df.select(group, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    counted = durable(rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_copies")))
    if spread is None:
        longest = counted.groupBy(group).count().agg(F.max("count")).first()[0]
        spread = longest is not None and longest > LONGEST_BRACKET
    points = small_table(counted_quantiles(counted, [group], value, [0, 0.25, 0.5, 0.75, 1], "q", spread))
    names = ["min", "q1", "median", "q3", "max"]
    points = points.select(group, *[F.get("q", F.lit(i)).alias(f"_{n}") for i, n in enumerate(names)])
    met = join_per_key(counted, points, [group], "inner", match_nulls=True)
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    inside = F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)
    return met.groupBy(group).agg(
        *[F.max(f"_{n}").alias(n) for n in names],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_copies"))).alias("n_beyond"),
    )


def trend_lines(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Straight-line fit of y on x, overall or per group."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept")
    )


def residual_fitted(fit: Fit) -> DataFrame:
    """Distinct (fitted, residual) points with the number of rows behind each, and √|residual|."""
    rows = fit.predictions()
    return rows.select("fitted", "residual", F.sqrt(F.abs("residual")).alias("scale"), F.col(WEIGHT).alias("n"))


def with_scale(augmented: DataFrame) -> DataFrame:
    """The scale-location ordinate of an augmented table."""
    return augmented.withColumn("scale", F.sqrt(F.abs("residual")))


def qq_points(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str]) -> DataFrame:
    """Sorted values against normal quantiles at (i − a) / (n + 1 − 2a); a is 3/8 up to ten values, else 1/2."""
    rows = df.filter(F.col(value).isNotNull())
    sizes = small_table(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    ranked = join_per_key(number_rows(rows, keys, [value, *tiebreak], "rank"), sizes, keys, "inner", match_nulls=True)
    a = F.when(F.col("_n") <= 10, 0.375).otherwise(0.5)
    return ranked.withColumn(
        "theoretical", special.normal_quantile_udf((F.col("rank") - a) / (F.col("_n") + 1 - 2 * a))
    ).drop("_n")


def qq_line(points: DataFrame, keys: Sequence[str], value: str, spread: bool | None = None) -> DataFrame:
    """The line through the first and third quartiles of sample and normal."""
    q = quantiles(points, keys, value, [0.25, 0.75], "q", spread)
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    z = float(special.normal_quantile(0.75))
    slope = (high - low) / (2 * z)
    return q.select(*keys, slope.alias("slope"), (low + slope * z).alias("intercept"))


def leverage(fit: Fit, keep: Sequence[str] = ()) -> DataFrame:
    """Cells of a linear fit with leverage, standardised residual and Cook's distance."""
    columns = list(fit.design.columns.values())
    sigma2 = fit.measures["sigma"] ** 2
    bread = fit.covariance / sigma2
    hat = F.lit(0.0)
    for a, i in enumerate(fit.kept):
        for b, j in enumerate(fit.kept[: a + 1]):
            hat = hat + columns[i] * columns[j] * F.lit(float(bread[a, b] * (1 if a == b else 2)))
    rows = fit.predictions().withColumn("hat", hat)
    standard = F.col("residual") / F.sqrt(F.lit(sigma2) * (1 - F.col("hat")))
    return rows.withColumn("std_residual", standard).withColumn(
        "cooks_distance", standard * standard * F.col("hat") / (1 - F.col("hat")) / len(fit.kept)
    ).select(*keep, "fitted", "residual", "hat", "std_residual", "cooks_distance", F.col(WEIGHT).alias("n"))


def loess_line(
    df: DataFrame, key: str, x: str, y: str, span: float = 0.75, points: int = 80, degree: int = 2
) -> DataFrame:
    """Local regression with tricube weights on a grid of points per group.

    Rows are reduced to (n, Σy) per distinct x first; each distinct x then meets the grid points of its
    group, a constant number, and every local fit is a handful of weighted sums solved in closed form.
    """
    sums = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(x).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sum_y")
    )
    ends = sums.groupBy(key).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("total"))
    near = join_per_key(sums, small_table(ends), [key], "inner", match_nulls=True)
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    near = near.withColumn("place", place).withColumn(
        "at", F.col("low") + (F.col("high") - F.col("low")) * F.col("place") / (points - 1)
    ).withColumn("away", F.abs(F.col("x") - F.col("at")))
    # Bandwidth: the distance that takes in the nearest share of rows.
    wanted = F.floor(F.col("total") * span + 1e-5)
    steps = near.groupBy(key, "place", "away").agg(F.sum("n").alias("_copies"), F.max("total").alias("total"))
    reached = cumulative_counts(steps, [key, "place"], "away").filter(F.col("_before") + F.col("_copies") >= wanted)
    widths = reached.groupBy(key, "place").agg(F.min("away").alias("width"))
    band = join_per_key(near, small_table(widths), [key, "place"], "inner", match_nulls=True)
    u = F.col("away") / F.col("width")
    weight = F.when(u < 1, F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))).otherwise(0.0)
    d = F.col("x") - F.col("at")
    moments = [F.sum(weight * F.col("n") * F.pow(d, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)]
    targets = [F.sum(weight * F.col("sum_y") * F.pow(d, F.lit(k))).alias(f"t{k}") for k in range(degree + 1)]
    fits = band.groupBy(key, "place", "at").agg(*moments, *targets)
    return fits.select(key, F.col("at").alias(x), _local_value(degree).alias("smooth"))


def _local_value(degree: int) -> Column:
    """Value at the centre of a weighted polynomial fit; falls back to lower degrees when singular."""
    s, t = (lambda k: F.col(f"s{k}")), (lambda k: F.col(f"t{k}"))
    mean = F.try_divide(t(0), s(0))
    line_det = s(0) * s(2) - s(1) * s(1)
    line = F.when(line_det > 1e-10 * s(0) * s(2), (t(0) * s(2) - t(1) * s(1)) / line_det).otherwise(mean)
    if degree == 1:
        return line
    c0, c1, c2 = s(2) * s(4) - s(3) * s(3), s(2) * s(3) - s(1) * s(4), s(1) * s(3) - s(2) * s(2)
    det = s(0) * c0 + s(1) * c1 + s(2) * c2
    return F.when(det > 1e-10 * s(0) * s(2) * s(4), (t(0) * c0 + t(1) * c1 + t(2) * c2) / det).otherwise(line)
