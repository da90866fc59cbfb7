"""From a visit registry to the modelling tables.

Dictionaries (code lists, excluded episodes, region postcodes, arrival, cause and place recodes,
department flags) are input tables: they belong to the registry, not to the library.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators.sizing import durable
from visitlens.operators.skew import hot_tokens
from visitlens.operators.summaries import keep_levels, lump_rare
from visitlens.operators.tables import drop_listed, first_rule, flag_matrix_to_map, keep_listed, lookup, map_literal
from visitlens.operators.visits import visit_number


@dataclass(frozen=True)
class Dictionaries:
    """`arrivals` and `causes` are (value, result); `places` is (value, result, priority)."""

    codes: Sequence[str]
    excluded_episodes: DataFrame
    postcodes: DataFrame
    arrivals: DataFrame
    causes: DataFrame
    places: DataFrame
    nationality: str = "IS"
    arrival_null_token: str = "NA"


COHORT_COLUMNS = [
    "patient_id", "monthyear", "quarteryear", "postalcode", "response", "age_group", "sex", "arrival", "cause",
    "place", "care_path", "visit_count", "gcs_group", "stay_hours",
]


def cohort(registry: DataFrame, dictionaries: Dictionaries, ingest_key: str = "ingest_key") -> DataFrame:
    """Visits that meet the inclusion criteria, numbered per patient and recoded."""
    included = registry.filter(
        S.contains_any_code(F.col("dx_text"), dictionaries.codes) & (F.col("nationality") == dictionaries.nationality)
    )
    included = drop_listed(included, F.col("episode_name"), dictionaries.excluded_episodes, "episode_name")
    included = keep_listed(included, F.col("postcode"), dictionaries.postcodes, "postcode")
    # The included visits are read several times from here on; written once, the registry is scanned once.
    included = durable(included)
    hot = hot_tokens(included, ["patient_id"])
    # Numbered and lumped on all included visits, before visits without a usable sex code are dropped.
    numbered = visit_number(included, "patient_id", [ingest_key], "visit_count", hot)
    lumped = lump_rare(numbered, "postcode").withColumn("sex", S.sex_label(F.col("sex_code"))).filter("sex is not null")
    recoded = lookup(lumped, F.col("arrival_mode"), dictionaries.arrivals, "value", "result", "arrival", fixed.UNKNOWN)
    recoded = lookup(recoded, F.col("cause"), dictionaries.causes, "value", "result", "cause", fixed.UNKNOWN)
    recoded = first_rule(recoded, F.lower("place"), dictionaries.places, "place", "unknown")
    return recoded.select(
        "patient_id",
        S.month_ordinal(F.col("arrival_date")).alias("monthyear"),
        S.quarter_label(F.col("arrival_date")).alias("quarteryear"),
        F.col("postcode").alias("postalcode"),
        S.within_days(F.col("arrival_date"), F.col("death_date")).alias("response"),
        S.age_group(F.col("age")).alias("age_group"),
        "sex",
        F.when(~F.col("arrival_mode").eqNullSafe(F.lit(dictionaries.arrival_null_token)), F.col("arrival")).alias("arrival"),
        "cause", "place", "care_path", "visit_count",
        S.gcs_group(F.col("gcs")).alias("gcs_group"),
        "stay_hours",
    )


def missing_flags(rows: DataFrame) -> DataFrame:
    """0/1 marks of missing or unknown entries; the coma-scale group gives way to its mark."""
    unknown = {c: S.if_else(F.col(c) == fixed.UNKNOWN, 1, 0) for c in ("cause", "arrival")}
    return rows.withColumns({
        "missing_gcs": F.col("gcs_group").isNull().cast("int"),
        "missing_cause": unknown["cause"],
        "missing_arrival": unknown["arrival"],
        "missing_care_path": F.col("care_path").isNull().cast("int"),
    }).drop("gcs_group")


def path_categories(path: Column, departments: Column) -> Column:
    """Categories of a path's departments, in order and without repeats; unlisted ones are uncategorised."""
    names = F.coalesce(S.split_path(path), F.array(F.lit("")))
    mapped = F.transform(names, lambda n: F.coalesce(F.element_at(departments, n), F.lit(fixed.UNCATEGORIZED)))
    return F.array_distinct(mapped)


def department_map(matrix: DataFrame, categories: Sequence[str] | None = None) -> Column:
    """The department matrix as a map from cleaned name to category."""
    present = [c for c in (categories or fixed.DEPARTMENT_CATEGORIES) if c in matrix.columns]
    cleaned = matrix.withColumn("NAME", S.clean_department(F.col("NAME")))
    return map_literal(flag_matrix_to_map(cleaned, "NAME", present), "NAME", "category")


def categorise_care_path(rows: DataFrame, matrix: DataFrame, column: str = "care_path") -> DataFrame:
    """The path reduced to its first category; rehabilitation counts as uncategorised."""
    first = F.get(path_categories(F.col(column), department_map(matrix)), F.lit(0))
    return rows.withColumn(column, F.when(first == fixed.REHABILITATION, fixed.UNCATEGORIZED).otherwise(first))


def model_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First visits, and of these the ones with a known care path."""
    large = rows.filter(F.col("visit_count") == 1).drop("visit_count")
    return large, large.filter(F.col("care_path") != fixed.UNCATEGORIZED)


def three_arrivals(column: Column) -> Column:
    """Ambulance, family or other; a missing arrival is other."""
    return S.first_match([(column == k, v) for k, v in fixed.ARRIVAL_KEPT.items()], fixed.ARRIVAL_OTHER)


def refine_for_models(large: DataFrame, small: DataFrame, kept_postcodes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Children out, postcodes lumped again (large) or limited to the kept ones (small), three arrivals."""
    child = fixed.AGE_UPPER_LIMITS[0][1]
    large = lump_rare(large.filter(F.col("age_group") != child), "postalcode")
    small = small.filter(F.col("age_group") != child).withColumn("postalcode", keep_levels(F.col("postalcode"), kept_postcodes))
    return tuple(t.withColumn("arrival", three_arrivals(F.col("arrival"))) for t in (large, small))
