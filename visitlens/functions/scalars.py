"""Column functions with the null rules of the cohort definitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from visitlens.functions import fixed_values as fixed

MICROS_PER_DAY = 86_400_000_000


def is_in(column: Column, values: Iterable) -> Column:
    """Membership that is never null: a null is not a member."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def not_in(column: Column, values: Iterable) -> Column:
    """Non-membership; a null value counts as outside and is kept by a filter."""
    return ~is_in(column, values)


def contains_any_code(column: Column, codes: Sequence[str]) -> Column:
    """Unanchored alternation of the codes as patterns, so `.` matches any character."""
    return column.rlike("|".join(codes))


def starts_with(column: Column, prefix: str) -> Column:
    """Prefix test that is false for a null."""
    return F.coalesce(column.startswith(prefix), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice where an unknown condition gives null instead of `no`."""
    return F.when(condition, yes).when(~condition, no)


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """Ordered rules, first true one wins; an unknown condition falls through to the default."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def recode_exact(column: Column, mapping: Mapping[str, str], default: str, null_token: str | None = None) -> Column:
    """Exact recode of text; unlisted values and nulls get the default, `null_token` becomes null."""
    text = column.cast("string")
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    recoded = F.coalesce(F.element_at(pairs, text), F.lit(default))
    return recoded if null_token is None else F.when(~text.eqNullSafe(F.lit(null_token)), recoded)


def bin_by_upper(column: Column, limits, above: str, missing: str | None) -> Column:
    """Label of the first limit that is at least the value."""
    chain = F.when(column.isNull(), F.lit(missing))
    for limit, label in limits:
        chain = chain.when(column <= limit, label)
    return chain.otherwise(above)


def age_group(column: Column) -> Column:
    return bin_by_upper(column, fixed.AGE_UPPER_LIMITS, fixed.AGE_ABOVE, fixed.AGE_MISSING)


def bin_by_range(column: Column, ranges) -> Column:
    """Label of the closed range that holds the value, null outside all of them."""
    first, *rest = ranges
    chain = F.when(column.between(first[0], first[1]), first[2])
    for low, high, label in rest:
        chain = chain.when(column.between(low, high), label)
    return chain


def gcs_group(column: Column) -> Column:
    return bin_by_range(column, fixed.GCS_RANGES)


def sex_label(column: Column) -> Column:
    male, female = fixed.SEX_CODES["male"], fixed.SEX_CODES["female"]
    return F.when(column.isin(male), "male").when(column.isin(female), "female")


def na_if(column: Column, marker: str) -> Column:
    return F.nullif(column, F.lit(marker))


def as_number(column: Column, to: str = "double") -> Column:
    """Number read from text, null where the text is not a number."""
    return column.try_cast(to)


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_sequence(first: str = fixed.CALENDAR_FIRST, last: str = fixed.CALENDAR_LAST) -> Column:
    return F.expr(f"sequence(date'{first}', date'{last}', interval 1 month)")


def month_ordinal(day: Column) -> Column:
    """Position of the month on the closed calendar, null outside it."""
    position = (F.year(day) - fixed.CALENDAR_START_YEAR) * 12 + F.month(day)
    return F.when(position.between(1, fixed.CALENDAR_MONTHS), position)


def days_between(start: Column, end: Column) -> Column:
    """Difference in days as a double."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(MICROS_PER_DAY)


def within_days(start: Column, end: Column, days: int = fixed.RESPONSE_DAYS) -> Column:
    """1 when `end` lies at most `days` after `start` (earlier counts too), 0 otherwise or when one is null."""
    known = start.isNotNull() & end.isNotNull()
    return F.when(known & (days_between(start, end) <= days), 1).otherwise(0)


def log_shift(column: Column, shift: float = fixed.LOG_SHIFT) -> Column:
    return F.ln(column + F.lit(shift))


def region_class(region: Column, other: str = fixed.REGION_CLASS_OTHER) -> Column:
    """Capital, surrounding area or the rest; an unknown region stays null."""
    chain = F.when(region.isNull(), F.lit(None).cast("string"))
    for code, label in fixed.REGION_CLASSES:
        chain = chain.when(region == F.lit(code).cast("decimal(4,1)"), label)
    return chain.otherwise(other)


def exposure(region: Column, population: Column) -> Column:
    """Population of the region; visitors from abroad get a constant."""
    return F.when(region == fixed.REGION_ABROAD, F.lit(fixed.REGION_ABROAD_POPULATION)).otherwise(population)


def count_prefixed(columns: Sequence[str], prefix: str) -> Column:
    """How many of the columns start with the prefix in this row."""
    return F.size(F.filter(F.array(*columns), lambda code: starts_with(code, prefix)))


def split_path(column: Column) -> Column:
    return F.split(column, ";\\s*")


def clean_department(column: Column) -> Column:
    """A printed list entry without its index and quotes."""
    return F.regexp_replace(column, r'^\[\d+\]\s"|"$', "")
