"""Reading and writing tables: Parquet, CSV, published versions of snapshots, posterior draws."""

from __future__ import annotations

from datetime import datetime, timezone
import json
from pathlib import PurePosixPath
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from visitlens.operators.sizing import local_table


def scan_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """The Parquet table `name` of a folder, with a fixed schema when one is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


MANIFEST = "version string, path string, n_rows long, published_at timestamp, schema string"


def snapshot_path(folder: str, name: str, version: str) -> str:
    """Each run writes to a path of its own, so a finished snapshot is never overwritten by a later step."""
    return str(PurePosixPath(folder) / name / f"version={version}")


def published_snapshots(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(version, path, n_rows, published_at, schema) of every version whose files are complete; no rows before the first."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(_manifests(folder, name))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _manifests(folder: str, name: str) -> str:
    return str(PurePosixPath(folder) / f"{name}.published")


def write_snapshot(df: DataFrame, folder: str, name: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write the files of an attempt, then a manifest of one row that makes the version visible; returns the path.

    A writer that dies before the manifest leaves nothing that a reader sees, and the version can be written again. A
    published version is never written twice.
    """
    spark = df.sparkSession
    if not published_snapshots(spark, folder, name).filter(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} of {name} is published already")
    path = f"{snapshot_path(folder, name, version)}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    n_rows = spark.read.schema(df.schema).parquet(path).count()
    _publish(spark, folder, name, (version, path, n_rows, datetime.now(timezone.utc), df.schema.json()))
    return path


def _publish(spark: SparkSession, folder: str, name: str, row: tuple) -> None:
    """A folder of its own per manifest, so that writers of several versions do not meet."""
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("error").json(f"{_manifests(folder, name)}/{uuid.uuid4().hex}")


def read_snapshot(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A published version, the newest one without `version`, with the types it was written with."""
    known = published_snapshots(spark, folder, name)
    if version is not None:
        known = known.filter(F.col("version") == version)
    newest = known.orderBy(F.desc("published_at"), F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no published version{'' if version is None else f' {version}'} of {name} in {folder}")
    return spark.read.schema(StructType.fromJson(json.loads(newest["schema"]))).parquet(newest["path"])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("error").option("header", True).csv(path)
    return path


DRAW_FILES = 4096


def write_draws(draws: DataFrame, folder: str, name: str, version: str) -> str:
    """Posterior draws in long form, one folder per parameter, so one parameter can be read alone."""
    return write_snapshot(
        draws.repartition("parameter", F.pmod(F.xxhash64("chain", "iter"), F.lit(DRAW_FILES))), folder, name, version, ["parameter"]
    )


def lookup_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal dictionary as a table; being a local relation its size is known to the planner."""
    return local_table(spark, rows, schema)


def profile_shape(df: DataFrame) -> DataFrame:
    """Row count beside the name and type of every column."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema, start=1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("n_rows", F.inline(columns))
