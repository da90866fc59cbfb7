"""Keyed operations that stay balanced when one key holds a large part of the rows.

A key is heavy when it holds more than half an average shuffle partition. Candidates come from one
narrow scan (`freqItems` never misses a key above its support) and are then counted exactly, so an even
table has none and takes the plain one-shuffle plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.operators.sizing import durable, local_table, range_partitions, small_table

SMALLEST_SHARE = 1e-4
LARGEST_SHARE = 0.05
MOST_SALTS = 4_096
_POSITION_BITS = 33


def _token(keys: Sequence[str]) -> Column:
    # Null keys hash too; a collision only sends a normal key down the balanced path.
    return F.xxhash64(*keys)


def hot_tokens(df: DataFrame, keys: Sequence[str], share: float | None = None) -> list[int]:
    """Hashes of the keys that hold more than `share` of the rows; looked for at every size."""
    share = share or min(max(0.5 / range_partitions(df), SMALLEST_SHARE), LARGEST_SHARE)
    tokens = df.select(_token(keys).alias("token"))
    candidates = tokens.stat.freqItems(["token"], share).first()[0] or []
    if not candidates:
        return []
    counted = tokens.groupBy(F.when(F.col("token").isin(candidates), F.col("token")).alias("token")).count().collect()
    total = sum(n for _, n in counted)
    return sorted(token for token, n in counted if token is not None and n > share * total)


def global_index(df: DataFrame, order: Sequence[str | Column], out: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2, … in the given total order without a single-task window.

    One range shuffle; `monotonically_increasing_id` after the sort holds (partition, row), and the
    partition sizes, one row each, turn it into a global position. The sorted rows are made durable
    first: both uses must see the same partition bounds.
    """
    raw = f"_{out}_raw"
    part = F.shiftright(F.col(raw), _POSITION_BITS)
    placed = durable(
        df.repartitionByRange(range_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn(raw, F.monotonically_increasing_id())
    )
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = local_table(
        df.sparkSession, [(p, s) for (p, _), s in zip(sizes, starts)], f"{raw}_part long, {raw}_start long"
    )
    inside = F.col(raw).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), part == F.col(f"{raw}_part"))
        .withColumn(out, F.col(f"{raw}_start") + inside)
        .drop(raw, f"{raw}_part", f"{raw}_start")
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition &= left[key].eqNullSafe(right[key])
    return condition


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    hot: list[int] | None = None,
) -> DataFrame:
    """`row_number` within `keys`; groups of heavy keys are spread over range partitions."""
    keys = list(keys)
    if not keys:
        return global_index(df, order, out).withColumn(out, F.col(out) + 1)
    hot = hot_tokens(df, keys) if hot is None else hot
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if not hot:
        return df.withColumn(out, numbered)
    is_hot = _token(keys).isin(hot)
    cold = df.filter(~is_hot).withColumn(out, numbered)
    placed = global_index(df.filter(is_hot), [*keys, *order], "_place")
    starts = small_table(placed.groupBy(*keys).agg(F.min("_place").alias("_first")))
    spread = (
        placed.join(starts, _null_safe(placed, starts, keys))
        .select(*[placed[c] for c in df.columns], (F.col("_place") - F.col("_first") + 1).alias(out))
    )
    return cold.unionByName(spread)


def join_per_key(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: list[int] | None = None,
    match_nulls: bool = False,
) -> DataFrame:
    """Join rows to a table with one row per key (a lookup or an aggregate), salting heavy keys.

    Keeps every column of `left` and adds the other columns of `right`. The salt depends on the row
    and its partition only, so a re-run task places its rows as before.
    """
    keys = list(keys)
    hot = hot_tokens(left, keys) if hot is None else hot
    added = [c for c in right.columns if c not in keys]
    right = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    condition = F.lit(True)
    for key in keys:
        other = right[f"_{key}_right"]
        condition &= left[key].eqNullSafe(other) if match_nulls else left[key] == other
    if hot:
        salts = min(max(range_partitions(left), 8), MOST_SALTS)
        salt = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(salts)).cast("int")
        copies = F.when(
            _token([f"_{k}_right" for k in keys]).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))
        ).otherwise(F.array(F.lit(0)))
        salted = left.withColumn("_salt", F.when(_token(keys).isin(hot), salt).otherwise(0))
        right = right.withColumn("_salt_right", F.explode(copies))
        condition &= salted["_salt"] == right["_salt_right"]
        joined = salted.join(right, condition, how)
    else:
        joined = left.join(right, condition, how)
    return joined.select(*left.columns, *([] if how in ("left_semi", "left_anti") else added))


def with_group_value(
    df: DataFrame, keys: Sequence[str], hot: list[int] | None = None, **values: Column
) -> DataFrame:
    """Attach group aggregates to each row: a combined aggregate, then a join back on the key.

    Null keys form a group of their own, as in any grouped aggregate.
    """
    keys = list(keys)
    groups = df.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()])
    return join_per_key(df, groups, keys, "left", hot, match_nulls=True)
