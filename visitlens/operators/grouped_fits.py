"""A straight line per group in closed form: one aggregate, no model object and no group gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitlens.functions import fixed_values as fixed, special
from visitlens.operators.sizing import small_table
from visitlens.operators.skew import join_per_key


def group_lines(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per group: n, line, sums of squares, standard errors, t values, R² and F."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    lines = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(xs).alias("x_mean"),
        F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_sxx(ys, xs).alias("sxx"), F.regr_syy(ys, xs).alias("syy"), F.regr_sxy(ys, xs).alias("sxy"),
    )
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    df_residual = F.col("n") - 2
    measured = lines.withColumn("rss", rss).withColumn(
        "sigma", F.when(df_residual > 0, F.sqrt(F.col("rss") / df_residual))
    )
    slope_se = F.try_divide(F.col("sigma"), F.sqrt("sxx"))
    intercept_se = F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(F.col("x_mean") * F.col("x_mean"), F.col("sxx")))
    r2 = 1 - F.try_divide(F.col("rss"), F.col("syy"))
    return measured.withColumns({
        "slope_se": slope_se, "intercept_se": intercept_se, "r_squared": r2,
        "f_statistic": F.try_divide(r2 * df_residual, 1 - r2),
    })


def fit_by_group(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Tidy table (group, term, estimate, std_error, statistic, p_value) of each group's line."""
    lines = group_lines(df, key, x, y)
    term = lambda name, estimate, error: F.struct(
        F.lit(name).alias("term"), F.col(estimate).alias("estimate"), F.col(error).alias("std_error"))
    tidy = lines.select(key, (F.col("n") - 2).cast("double").alias("_df"), F.inline(
        F.array(term("(Intercept)", "intercept", "intercept_se"), term(x, "slope", "slope_se"))))
    tidy = tidy.withColumn("statistic", F.try_divide("estimate", "std_error"))
    return tidy.withColumn("p_value", special.t_two_sided_udf("statistic", "_df")).drop("_df")


def significant(terms: DataFrame, term: str, level: float = fixed.SIGNIFICANCE) -> DataFrame:
    return terms.filter((F.col("term") == term) & (F.col("p_value") < level))


def fit_statistics(df: DataFrame, key: str, x: str, y: str, level: float = fixed.SIGNIFICANCE) -> DataFrame:
    """R² and F per group with the critical F value at the level."""
    lines = group_lines(df, key, x, y)
    return lines.select(
        key, "r_squared", "f_statistic",
        special.f_quantile_udf(F.lit(1 - level), F.lit(1.0), (F.col("n") - 2).cast("double")).alias("f_critical"),
    )


def augment_by_group(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Each row with its group's fit: fitted, residual, leverage, leave-one-out sigma, Cook's distance."""
    lines = small_table(group_lines(df, key, x, y).select(key, "n", "x_mean", "slope", "intercept", "sxx", "rss", "sigma"))
    rows = join_per_key(df, lines, [key], "inner")
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    rows = rows.withColumn("fitted", F.col("intercept") + F.col("slope") * xs).withColumns({
        "residual": ys - F.col("fitted"),
        "hat": 1 / F.col("n") + F.try_divide(F.pow(xs - F.col("x_mean"), F.lit(2)), F.col("sxx")),
    })
    rest = 1 - F.col("hat")
    spare = F.col("rss") - F.try_divide(F.col("residual") * F.col("residual"), rest)
    standard = F.try_divide(F.col("residual"), F.col("sigma") * F.sqrt(rest))
    return rows.withColumns({
        "sigma_without": F.when(F.col("n") > 3, F.sqrt(F.greatest(spare, F.lit(0.0)) / (F.col("n") - 3))),
        "std_residual": standard,
        "cooks_distance": standard * standard * F.try_divide(F.col("hat"), rest) / 2,
    }).select(*df.columns, "fitted", "residual", "hat", "sigma_without", "cooks_distance", "std_residual")
