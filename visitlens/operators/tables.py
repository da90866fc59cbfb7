"""Joins, grids, stacking and reshaping of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.operators.sizing import rows_if_small, small_table


def full_join_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Outer join on one key; other columns present on both sides get the suffixes."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    renamed = [
        side.withColumnsRenamed({c: c + suffix for c in shared}) for side, suffix in zip((left, right), suffixes)
    ]
    return renamed[0].join(renamed[1], key, "full")


def cross_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every distinct value of `a` with every distinct value of `b`.

    The values of `b` are dealt into blocks and every value of `a` visits each block once, so the grid is
    an equality join that spreads over the blocks and no list of values is held in one place. A null `b`
    makes no column of the grid.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = df.select(a).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = df.select(b).filter(F.col(b).isNotNull()).distinct()
    right = right.withColumn("_block", F.pmod(F.xxhash64(b), F.lit(blocks)).cast("int"))
    return left.join(right, "_block").select(a, b)


def zero_fill_grid(counts: DataFrame, a: str, b: str, count: str) -> DataFrame:
    """The count table completed to its full grid; combinations never seen count 0.

    The counts are used three times, so a table proven small is computed once and kept.
    """
    counts = small_table(counts)
    grid = cross_grid(counts, a, b)
    return grid.join(counts, [a, b], "left").fillna({count: 0})


def keep_listed(df: DataFrame, key: Column, listed: DataFrame, name: str) -> DataFrame:
    """Rows whose key is in a table of values."""
    listed = small_table(listed.select(F.col(name).alias("_listed")).distinct())
    return df.join(listed, key == F.col("_listed"), "left_semi")


def drop_listed(df: DataFrame, key: Column, listed: DataFrame, name: str) -> DataFrame:
    """Rows whose key is not in a table of values; a null key is kept."""
    listed = small_table(listed.select(F.col(name).alias("_listed")).distinct())
    return df.join(listed, key == F.col("_listed"), "left_anti")


def lookup(df: DataFrame, key: Column, table: DataFrame, name: str, value: str, out: str, default) -> DataFrame:
    """Map a value through a dictionary table with one row per key, unlisted values to the default."""
    table = small_table(table.select(F.col(name).alias("_key"), F.col(value).alias("_value")))
    return (
        df.join(table, key == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_value", F.lit(default)))
        .drop("_key", "_value")
    )


def first_rule(df: DataFrame, key: Column, rules: DataFrame, out: str, default: str) -> DataFrame:
    """Recode through a rule table (value, result, priority); the lowest priority of a value wins."""
    winners = rules.groupBy("value").agg(F.min_by("result", "priority").alias("result"))
    return lookup(df, key, winners, "value", "result", out, default)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names matching a case-insensitive pattern, known when the plan is built."""
    return df.select(df.colRegex(f"`(?i){pattern}`")).columns


def stack_columns(df: DataFrame, columns: Sequence[str], out: str, keep: Sequence[str] = ()) -> DataFrame:
    """All values of several columns as one column, nulls removed."""
    return df.select(*keep, F.explode(F.array(*columns)).alias(out)).filter(F.col(out).isNotNull())


def pivot_longer(df: DataFrame, ids: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    values = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, names_to, values_to)


def sum_across(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sum of each column per key, nulls ignored and an all-null sum 0."""
    return df.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def column_sums(df: DataFrame, columns: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """Grand total of each column, one row per column."""
    totals = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])
    return totals.unpivot([], list(columns), names_to, values_to)


def flag_matrix_to_map(matrix: DataFrame, name: str, categories: Sequence[str]) -> DataFrame:
    """One category per name from 0/1 columns; the last flagged category in the list wins."""
    flagged = [
        F.when(F.col(f"`{c}`") == 1, F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("category")))
        for i, c in enumerate(categories)
    ]
    last = F.array_max(F.array_compact(F.array(*flagged)))
    per_row = matrix.select(F.col(name), last.alias("last")).filter("last is not null")
    return per_row.groupBy(name).agg(F.max("last")["category"].alias("category"))


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def map_literal(table: DataFrame, key: str, value: str) -> Column:
    """A dictionary table as a map expression, for lookups inside arrays; the size is checked."""
    rows = rows_if_small(table.select(key, value), 5_000)
    if rows is None:
        raise ValueError(f"more than 5000 keys in {key}: explode the array and join instead")
    pairs: Mapping[str, str] = dict(rows)
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
