"""Visit sequences within a patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitlens.operators.skew import hot_tokens, number_rows, with_group_value


def visit_number(df: DataFrame, patient: str, order: Sequence[str], out: str = "visit_number",
                 hot: list[int] | None = None) -> DataFrame:
    """Sequence number of a visit within its patient in the given order (it must break all ties)."""
    return number_rows(df, [patient], order, out, hot)


def first_visits(df: DataFrame, patient: str, order: Sequence[str]) -> DataFrame:
    """Each patient's first visit, as one combined aggregate: no group is ever sorted or gathered."""
    others = [c for c in df.columns if c != patient]
    first = df.groupBy(patient).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c == patient else F.col(f"_first.{c}").alias(c) for c in df.columns])


def patient_maximum(df: DataFrame, patient: str, value: str, out: str, hot: list[int] | None = None) -> DataFrame:
    """The patient's largest value on each of the patient's rows."""
    return with_group_value(df, [patient], hot, **{out: F.max(value)})


def numbered_with_maximum(df: DataFrame, patient: str, order: Sequence[str], keep, number: str, maximum: str) -> DataFrame:
    """Number all visits, then filter, then take the maximum over the visits that are left."""
    hot = hot_tokens(df, [patient])
    numbered = visit_number(df, patient, order, number, hot)
    return patient_maximum(numbered.filter(keep), patient, number, maximum, hot)
