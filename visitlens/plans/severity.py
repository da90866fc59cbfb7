"""Visits with their sequence number, the patient's maximum, exposure and region class."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators.sizing import small_table
from visitlens.operators.skew import join_per_key
from visitlens.operators.visits import numbered_with_maximum


def severity_table(visits: DataFrame, population: DataFrame, order: list[str]) -> DataFrame:
    """Numbered before and maximised after the filter on known gender and urgency.

    The total row of the population stays in: no visit has its region, so the join drops it.
    """
    kept = (F.col("gender") != 0) & F.col("urgency").isNotNull()
    numbered = numbered_with_maximum(visits, "patient_id", order, kept, "visit_number", "patient_maximum")
    people = population.select("year", "region", F.pow(F.lit(10.0), F.col("log10_pop")).alias("population"))
    few = small_table(people)
    keys = ["year", "region"]
    joined = numbered.join(few, keys) if few is not people else join_per_key(numbered, people, keys, "inner")
    return (
        joined
        .withColumns({
            "exposure": S.exposure(F.col("region"), F.col("population")),
            "year_since": F.col("year") - fixed.CALENDAR_START_YEAR,
            "region3": S.region_class(F.col("region"), fixed.REGION_CLASS_OTHER_SEVERITY),
        })
        .drop("population")
    )
