"""Visits per region and year with population exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators.tables import zero_fill_grid
from visitlens.operators.visits import first_visits


def counts_by_region_year(visits: DataFrame) -> DataFrame:
    return visits.groupBy("year", "region").agg(F.count(F.lit(1)).alias("count"))


def region_population(population: DataFrame) -> DataFrame:
    """Population per region and year without the total row."""
    return population.filter(F.col("region") != fixed.REGION_TOTAL_ROW).select(
        "year", "region", F.pow(F.lit(10.0), F.col("log10_pop")).alias("population")
    )


def _with_exposure(counts: DataFrame, population: DataFrame, log_count: Column) -> DataFrame:
    return counts.join(region_population(population), ["year", "region"], "left").select(
        "year", "region", "count", "population",
        S.region_class(F.col("region")).alias("region3"),
        (F.col("year") - fixed.CALENDAR_START_YEAR).alias("year_since"),
        log_count.alias("log_count"),
    )


def region_year_rates(visits: DataFrame, population: DataFrame) -> DataFrame:
    """Counts are taken first, so only region-years and not visits meet the population."""
    return _with_exposure(counts_by_region_year(visits), population, F.ln("count"))


def region_year_rates_first(visits: DataFrame, population: DataFrame, order: list[str]) -> DataFrame:
    """The same on each patient's first visit; only the columns counted travel through the aggregate."""
    needed = visits.select(*dict.fromkeys(["patient_id", *order, "year", "region"]))
    return region_year_rates(first_visits(needed, "patient_id", order), population)


def region_year_rates_filled(visits: DataFrame, population: DataFrame) -> DataFrame:
    """The same on the full year by region grid; empty combinations count 0 and the log is shifted."""
    filled = zero_fill_grid(counts_by_region_year(visits), "year", "region", "count")
    return _with_exposure(filled, population, S.log_shift(F.col("count")))


def bias(scored: DataFrame, link: str) -> DataFrame:
    """Predicted minus observed count per region and year, both on the count scale."""
    return scored.select("year", "region", (F.exp(link) - F.col("count")).alias("bias"))
