"""Sinks: partitioned tables that are never overwritten, and a provenance record."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, *partitions: str) -> None:
    """Write Parquet; an existing path is an error, so published results never change."""
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def write_set(tables: Mapping[str, DataFrame], root: str, partitions: Mapping[str, tuple[str, ...]] | None = None) -> None:
    """Several tables below one root that holds none yet."""
    for name, df in tables.items():
        write_new(df, f"{root}/{name}", *(partitions or {}).get(name, ()))


#: Tables of a detector's result, each with its partition columns.
STANDARD = {"events": ("event_date",), "channel_status": (), "daily_summary": (), "scores_30min": ("event_date",), "scores_15min": ("event_date",)}
LOF = {"points": (), "bins_15min": (), "point_events": (), "bin_events": (), "strict_events": (), "summary": (), "metadata": ()}
WINDOWED = {"windows": (), "scores": (), "meter_summary": ()}


def write_named(tables: Mapping[str, DataFrame], root: str, kind: Mapping[str, tuple[str, ...]] = STANDARD) -> None:
    """A whole result set below a new root: each of the set's tables must be there, and no other."""
    if set(tables) != set(kind):
        raise ValueError(f"missing {sorted(set(kind) - set(tables))}, unknown {sorted(set(tables) - set(kind))}")
    write_set(tables, root, kind)


def merge_parts(parts: DataFrame, keys: list[str], path: str) -> None:
    """Write shards that were read together as one table; a key in two shards is an error."""
    again = parts.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if again:
        raise ValueError(f"keys repeat across parts: {[tuple(r)[:-1] for r in again]}")
    write_new(parts, path)


def rebuilt(spark: SparkSession, shards: str, derive: Mapping[str, Callable[[DataFrame], DataFrame]], root: str) -> None:
    """Write derived tables anew from completed shards (folders with a _SUCCESS file) without running what made the shards."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(shards).getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(s.getPath().getParent().toString() for s in fs.globStatus(Path(f"{shards}/*/_SUCCESS")) or ())
    if not done:
        raise FileNotFoundError(f"no completed shards below {shards}")
    rows = spark.read.parquet(*done)
    write_set({name: make(rows) for name, make in derive.items()}, root)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def signature(config: Mapping, inputs: DataFrame) -> DataFrame:
    """One row: SHA-256 over the configuration and the inputs' file paths, sizes and times."""
    files = inputs.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct()
    listed = files.agg(F.to_json(F.sort_array(F.collect_list(F.struct("p", "s", "t")))).alias("files"))
    return listed.select(F.sha2(F.concat(F.lit(json.dumps(dict(config), sort_keys=True)), "files"), 256).alias("signature"), "files")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two snapshots hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def session(name: str, **conf: str) -> SparkSession:
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        build = build.config(k, v)
    return build.getOrCreate()
