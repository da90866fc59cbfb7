"""Size checks that decide between a broadcast and a shuffle, and durable lineage cuts."""

from __future__ import annotations

import math
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SMALL_ROWS = 50_000
SMALL_TABLE_BYTES = 16 * 1024 * 1024
ROWS_PER_PARTITION = 1_000_000


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle: the session's number, more when the counted rows need it.

    The rows are counted, as a plan's size estimate multiplies over joins and says little about the rows.
    """
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(math.ceil(df.count() / ROWS_PER_PARTITION), 200_000))


def rows_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> list | None:
    """The rows when there are at most `max_rows`, else None; never fetches more than that plus one."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def local_table(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """Driver rows as a table whose size the planner knows, so that joins to it need no shuffle."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = _arrow([tuple(r) for r in rows], schema)
    return spark.createDataFrame([], schema) if table is None else spark.createDataFrame(table, schema)


def _arrow(rows: list[tuple], schema: StructType) -> pa.Table | None:
    return pa.table([[r[i] for r in rows] for i in range(len(schema))], names=schema.names) if rows else None


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcast when its rows and bytes are proven small, else unchanged.

    The check keeps the rows it read, so a small aggregate is computed once and not once per use.
    """
    rows = rows_if_small(df, max_rows)
    if rows is None:
        return df
    table = _arrow([tuple(r) for r in rows], df.schema)
    if table is None:
        return F.broadcast(df.sparkSession.createDataFrame([], df.schema))
    if table.nbytes > SMALL_TABLE_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def scalar(df: DataFrame, column: Column) -> Column:
    """One aggregate of `df` as a scalar subquery, usable in any expression."""
    return df.agg(column).scalar()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session may fall back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="visitlens-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, so that a lost executor never re-runs what is above it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)
