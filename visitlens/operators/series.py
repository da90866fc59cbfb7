"""Ordered series: positions, differences, autocorrelation and the lag table of the unit-root test.

A series is indexed once (range shuffle, durable). Everything that looks back works on blocks of a
fixed length that carry a copy of the rows just before them, so no task sees the whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.operators.skew import global_index

BLOCK = 50_000


def indexed(df: DataFrame, order: Sequence[str | Column], out: str = "position") -> DataFrame:
    """Rows with their 1-based position in the order."""
    return global_index(df, order, "_zero").withColumn(out, F.col("_zero") + 1).drop("_zero")


def slice_rows(df: DataFrame, first: int, last: int, position: str = "position") -> DataFrame:
    return df.filter(F.col(position).between(first, last))


def with_halo(series: DataFrame, position: str, halo: int, block: int = BLOCK) -> DataFrame:
    """Each row in its own block, and once more in the next block when it is among its last `halo` rows."""
    if halo > block:
        raise ValueError("the look-back must not exceed a block")
    zero = F.col(position) - 1
    own = F.floor(zero / F.lit(block))
    tail = zero % F.lit(block) >= F.lit(block - halo)
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = series.withColumn("_block", F.explode(blocks))
    return spread.withColumn("_own", F.col("_block") == own)


def lags(series: DataFrame, value: str, position: str, depth: int, block: int = BLOCK, prefix: str = "lag_") -> DataFrame:
    """Columns lag_1 … lag_depth of an indexed series, null where the series has not begun."""
    window = Window.partitionBy("_block").orderBy(position)
    columns = {f"{prefix}{k}": F.lag(value, k).over(window) for k in range(1, depth + 1)}
    return with_halo(series, position, depth, block).withColumns(columns).filter("_own").drop("_block", "_own")


def difference(series: DataFrame, value: str, position: str, out: str = "difference", block: int = BLOCK) -> DataFrame:
    """First difference; the first row has none and is dropped."""
    previous = lags(series, value, position, 1, block, "_previous_")
    return (
        previous.withColumn(out, F.col(value) - F.col("_previous_1"))
        .filter(F.col(position) > 1).drop("_previous_1")
    )


def default_lag_max(n: int) -> int:
    return min(int(10 * math.log10(n)), n - 1)


def autocorrelation(series: DataFrame, value: str, position: str, lag_max: int | None = None, block: int = BLOCK) -> DataFrame:
    """(lag, acf) for lags 0 … lag_max of an indexed series."""
    n, mean, spread = series.agg(F.count(value), F.avg(value), F.var_pop(value)).first()
    lag_max = default_lag_max(n) if lag_max is None else min(lag_max, n - 1)
    centred = series.select(position, (F.col(value) - F.lit(mean)).alias("x"))

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        x, own = rows["x"].to_numpy(), rows["_own"].to_numpy()
        sums = [float(np.sum((x[k:] * x[: len(x) - k])[own[k:]])) for k in range(min(lag_max, len(x) - 1) + 1)]
        return pd.DataFrame({"lag": np.arange(len(sums)), "product": sums})

    block = max(block, lag_max)
    parts = with_halo(centred, position, lag_max, block).groupBy("_block").applyInPandas(products, "lag int, product double")
    sums = parts.groupBy("lag").agg(F.sum("product").alias("product"))
    return sums.select("lag", (F.col("product") / F.lit(n * spread)).alias("acf"))
