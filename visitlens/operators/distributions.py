"""Count distributions: closed-form fits, densities over the counts, overdispersion and their AIC."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.functions import special
from visitlens.operators.design import Term
from visitlens.operators.fits import fit_glm, fit_negative_binomial
from visitlens.operators.sizing import local_table


def overdispersion(df: DataFrame, count: str) -> DataFrame:
    return df.agg(
        F.avg(count).alias("mean"), F.var_samp(count).alias("variance"),
        (F.var_samp(count) / F.avg(count)).alias("ratio"),
    )


def lognormal_fit(df: DataFrame, count: str) -> DataFrame:
    """Mean and sd of the log counts; the likelihood with and without the Jacobian term and ML variance.

    `log_likelihood` keeps the usual shorthand (n − 1 sd, no −Σ ln x); `log_likelihood_full` is the
    density of the counts themselves at the ML sd and is comparable across families.
    """
    x = F.ln(count)
    base = df.filter(F.col(count) > 0).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_log"), F.stddev_samp(x).alias("sd_log"),
        F.stddev_pop(x).alias("sd_ml"), F.sum(x).alias("sum_log"),
    )
    n, sd, ml = F.col("n"), F.col("sd_log"), F.col("sd_ml")
    half = -n / 2 * F.lit(math.log(2 * math.pi))
    return base.select(
        "n", "mean_log", "sd_log",
        (half - n * F.ln(sd) - n * ml * ml / (2 * sd * sd)).alias("log_likelihood"),
        (half - n * F.ln(ml) - n / 2 - F.col("sum_log")).alias("log_likelihood_full"),
    )


def pareto_fit(df: DataFrame, count: str) -> DataFrame:
    """Shape 1 + n / Σ ln(x / min) and scale min / (shape − 1), beside the maximum-likelihood pair (min, n / Σ …)."""
    positive = df.filter(F.col(count) > 0)
    base = positive.agg(
        F.count(F.lit(1)).alias("n"), F.min(count).cast("double").alias("minimum"), F.sum(F.ln(count)).alias("sum_log")
    )
    excess = F.col("sum_log") - F.col("n") * F.ln("minimum")
    shaped = base.withColumns({"shape": 1 + F.col("n") / excess, "shape_ml": F.col("n") / excess})
    shaped = shaped.withColumn("scale", F.col("minimum") / (F.col("shape") - 1))

    def likelihood(shape: str, scale: str) -> Column:
        a = F.col(shape)
        return F.col("n") * F.ln(a) + F.col("n") * a * F.ln(scale) - (a + 1) * F.col("sum_log")

    return shaped.select(
        "n", "shape", "scale", "shape_ml", F.col("minimum").alias("scale_ml"),
        likelihood("shape", "scale").alias("log_likelihood"),
        likelihood("shape_ml", "minimum").alias("log_likelihood_full"),
    )


def density_table(
    df: DataFrame, count: str, bin_width: float = 25.0, nb_mu: float = 100.0, nb_p: float = 0.75
) -> DataFrame:
    """Poisson, negative-binomial, log-normal and Pareto densities over 0 … the largest count.

    The continuous densities are scaled by rows × bin width to lie over a histogram of counts.
    """
    n, mean, highest = df.agg(F.count(count), F.avg(count), F.max(count)).first()
    log_row = lognormal_fit(df, count).first()
    pareto_row = pareto_fit(df, count).first()
    size = nb_mu * nb_p / (1 - nb_p)
    k = F.col("value").cast("double")
    log_factorial = special.log_gamma_udf(k + 1)
    poisson = F.exp(k * F.lit(math.log(mean)) - F.lit(mean) - log_factorial)
    negative = F.exp(
        special.log_gamma_udf(k + F.lit(size)) - F.lit(math.lgamma(size)) - log_factorial
        + F.lit(size * math.log(nb_p)) + k * F.lit(math.log(1 - nb_p))
    )
    z = (F.ln(k) - F.lit(log_row["mean_log"])) / F.lit(log_row["sd_log"])
    normal = F.exp(-z * z / 2) / (k * F.lit(log_row["sd_log"] * math.sqrt(2 * math.pi)))
    shape, scale = pareto_row["shape"], pareto_row["scale"]
    pareto = F.exp(F.lit(math.log(shape) + shape * math.log(scale)) - (shape + 1) * F.ln(k))
    zero = F.lit(0.0)
    return df.sparkSession.range(int(highest) + 1).withColumnRenamed("id", "value").select(
        "value", poisson.alias("poisson"), negative.alias("negative_binomial"),
        F.coalesce(F.when(k > 0, normal) * F.lit(n * bin_width), zero).alias("log_normal"),
        F.when(k >= F.lit(pareto_row["scale_ml"]), F.when(k >= F.lit(scale), pareto).otherwise(zero) * F.lit(n * bin_width)).alias("pareto"),
    )


def compare_aic(df: DataFrame, count: str, terms: Sequence[Term], offset: str) -> DataFrame:
    """AIC of the four families: as usually tabulated, and on one comparable scale."""
    log_row, pareto_row = lognormal_fit(df, count).first(), pareto_fit(df, count).first()
    poisson = fit_glm(df, terms, count, "poisson", offset).measures["aic"]
    negative = fit_negative_binomial(df, terms, count, offset).measures["aic"]
    rows = [
        ("Log-Normal", 4 - 2 * log_row["log_likelihood"], 4 - 2 * log_row["log_likelihood_full"]),
        ("Pareto", 4 - 2 * pareto_row["log_likelihood"], 4 - 2 * pareto_row["log_likelihood_full"]),
        ("Poisson", poisson, poisson), ("Negative Binomial", negative, negative),
    ]
    return local_table(df.sparkSession, rows, "model string, aic_as_given double, aic_comparable double")
