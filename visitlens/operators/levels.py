"""Factor levels as tables: a level dictionary beside the data instead of a column attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitlens.operators.sizing import local_table, rows_if_small, small_table
from visitlens.operators.skew import global_index, join_per_key


def level_dictionary(df: DataFrame, column: str, reference: str | None = None) -> DataFrame:
    """(level, code): sorted distinct levels numbered from 1, the reference level moved to the front.

    Levels are those present, so unused ones are gone.
    """
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    first = F.col("level") != F.lit(reference) if reference is not None else F.lit(False)
    rows = rows_if_small(levels)
    if rows is None:
        placed = global_index(levels, [first, "level"], "_place")
        return placed.select("level", (F.col("_place") + 1).cast("int").alias("code"))
    ordered = sorted((r[0] for r in rows), key=lambda v: (reference is not None and v != reference, v))
    kind = levels.schema["level"].dataType.simpleString()
    return local_table(df.sparkSession, [(v, i) for i, v in enumerate(ordered, start=1)], f"level {kind}, code int")


def encode(df: DataFrame, column: str, out: str, reference: str | None = None) -> DataFrame:
    """Attach the level code of a column; a null value keeps a null code."""
    levels = small_table(level_dictionary(df, column, reference))
    renamed = levels.withColumnsRenamed({"level": column, "code": out})
    return join_per_key(df, renamed, [column], "left")
