"""Diagnosis categories (first letter of a code) in total and over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitlens.functions import fixed_values as fixed, scalars as S
from visitlens.operators.grouped_fits import augment_by_group, fit_by_group, fit_statistics, significant
from visitlens.operators.sizing import rows_if_small, small_table
from visitlens.operators.tables import stack_columns


def blank_missing(visits: DataFrame, columns: Sequence[str]) -> DataFrame:
    return visits.withColumns({c: S.na_if(F.col(c), fixed.NO_DIAGNOSIS) for c in columns})


def first_letters(visits: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per recorded diagnosis with its category letter."""
    codes = stack_columns(blank_missing(visits, columns), columns, "code", keep)
    return codes.withColumn("letter", F.substring("code", 1, 1))


def distinct_letters(visits: DataFrame, columns: Sequence[str]) -> list[str]:
    """The categories present; as first letters of codes they are few, which is checked."""
    rows = rows_if_small(first_letters(visits, columns).select("letter").distinct(), 1_000)
    if rows is None:
        raise ValueError("more than 1000 first letters: these columns do not hold category codes")
    return sorted(r[0] for r in rows)


def letter_counts(visits: DataFrame, columns: Sequence[str], letters: Sequence[str] | None = None) -> DataFrame:
    """A `<letter>_total` column per category: how many of the row's codes start with it."""
    letters = distinct_letters(visits, columns) if letters is None else letters
    blanked = blank_missing(visits, columns)
    return blanked.withColumns({f"{x}_total": S.count_prefixed(columns, x) for x in letters})


def _letters_with_blanks(visits: DataFrame, columns: Sequence[str], *keep) -> DataFrame:
    """One row per recorded diagnosis, and one with a null category for a visit without any."""
    codes = F.array_compact(F.array(*[S.na_if(F.col(c), fixed.NO_DIAGNOSIS) for c in columns]))
    letters = F.transform(codes, lambda code: F.substring(code, F.lit(1), F.lit(1)))
    return visits.select(*keep, F.explode_outer(letters).alias("letter"))


def letter_totals(visits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(category, total) over all visits, counted in long form so the letters need no pass of their own."""
    counted = _letters_with_blanks(visits, columns).filter("letter is not null").groupBy("letter").agg(F.count(F.lit(1)).alias("total"))
    return counted.select(F.concat("letter", F.lit("_total")).alias("category"), "total")


def letters_by_year(visits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(year, category, total) for visits of known gender and urgency, categories never seen in a year at 0.

    One pass counts (year, letter); the grid of years with such visits by all letters comes from the counts.
    """
    kept = F.coalesce((F.col("gender") != 0) & F.col("urgency").isNotNull(), F.lit(False))
    rows = _letters_with_blanks(visits, columns, "year", kept.alias("kept"))
    counted = small_table(rows.groupBy("year", "letter").agg(F.count_if("kept").alias("total")))
    shown = counted.join(counted.filter("total > 0").select("year").distinct(), "year", "left_semi")
    letters = counted.filter("letter is not null").select("letter").distinct()
    grid = shown.select("year").distinct().withColumn(
        "letter", F.explode(letters.agg(F.array_sort(F.collect_set("letter"))).scalar())
    )
    filled = grid.join(shown, ["year", "letter"], "left").fillna({"total": 0})
    return filled.select("year", F.concat("letter", F.lit("_total")).alias("category"), "total")


def trend_report(visits: DataFrame, columns: Sequence[str], level: float = fixed.SIGNIFICANCE) -> DataFrame:
    """Yearly totals of the categories with a significant trend, with line, fit statistics and diagnostics."""
    yearly = small_table(letters_by_year(visits, columns))
    terms = significant(fit_by_group(yearly, "category", "year", "total"), "year", level)
    trends = small_table(terms.select("category", F.col("estimate").alias("slope"), "p_value"))
    shown = yearly.join(trends, "category", "left_semi")
    rows = augment_by_group(shown, "category", "year", "total").join(trends, "category")
    return rows.join(fit_statistics(shown, "category", "year", "total", level), "category")
