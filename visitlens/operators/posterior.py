"""Posterior draws beside a generalised linear model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitlens.operators.fits import odds_table
from visitlens.operators.summaries import draw_summary

ODDS_COLUMNS = ["parameter", "odds_ratio", "lower", "upper", "type"]


def draw_odds(draws: DataFrame) -> DataFrame:
    """exp of the posterior median and of the bounds of the 95 % interval."""
    return draw_summary(draws).select(
        "parameter", F.exp("median").alias("odds_ratio"), F.exp("ci_low").alias("lower"), F.exp("ci_high").alias("upper")
    )


def compare_odds(terms: DataFrame, draws: DataFrame) -> DataFrame:
    """Odds ratios of both sources stacked, tagged by source."""
    glm = odds_table(terms).withColumn("type", F.lit("GLM"))
    bayes = draw_odds(draws).withColumn("type", F.lit("Bayesian"))
    return glm.select(*ODDS_COLUMNS).unionByName(bayes.select(*ODDS_COLUMNS))
