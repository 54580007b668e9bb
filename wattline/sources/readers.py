"""Readers: day folders, archives, score files, channel metadata and manifests."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.scalars import parse_bool, review_flag
from wattline.operators.contract import SCORES, missing_columns

#: Measurements of a raw meter file, in file order.
MEASUREMENTS = ("powerFactor", "pRealKw", "pRealPositiveKw", "pRealNegativeKw", "pReactiveKw", "pReactivePositiveKw", "pReactiveNegativeKw", "vRMSMin", "vRMSMax", "iRMSMin", "iRMSMax")
RAW = T.StructType([T.StructField("timestamp", T.StringType()), *[T.StructField(m, T.DoubleType()) for m in MEASUREMENTS]])
METADATA = "organization string, channels array<struct<id:string,category_id:int,category_name:string,metadata:struct<rated_power:double>>>"


def with_source(df: DataFrame) -> DataFrame:
    """Adds series_id (file stem), folder_date (DD_MM_YYYY anywhere in the path), source_file, and block and position, which order a file's rows."""
    path = F.col("_metadata.file_path")
    day = F.regexp_extract(path, r"(\d{2}_\d{2}_\d{4})", 1)
    return df.select("*", F.regexp_extract(path, r"([^/]+)\.csv$", 1).alias("series_id"), F.try_to_timestamp(day, F.lit("dd_MM_yyyy")).cast("date").alias("folder_date"), path.alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"))


def day_folders(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files below ``root``; unreadable timestamps become null."""
    df = spark.read.schema(RAW).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    return with_source(df).withColumn("timestamp", F.try_to_timestamp("timestamp"))


def archive_members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, content) of a zip or tar archive; other kinds are refused."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.namelist():
                if not m.endswith("/"):
                    yield m, z.read(m)
    elif name.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    else:
        raise ValueError(f"unsupported archive: {name}")


#: Names of archives; other files of a folder are left alone.
ARCHIVES = "{*.zip,*.tar,*.tar.gz,*.tgz}"


def archives(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the CSV members of all archives in ``root``, one task an archive.

    A member without a timestamp column is an error; absent measurements are null.
    """
    cols = ["timestamp", *MEASUREMENTS]

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                for member, data in archive_members(path, raw):
                    if member.endswith(".csv"):
                        part = pd.read_csv(io.BytesIO(data))
                        if "timestamp" not in part.columns:
                            raise ValueError(f"{path}: {member} has no timestamp column")
                        part = part.reindex(columns=cols)
                        part["timestamp"] = part["timestamp"].astype(str)
                        yield part.assign(member=member, source_file=f"{path}!{member}", position=range(len(part)))

    schema = "timestamp string, " + ", ".join(f"{m} double" for m in MEASUREMENTS) + ", member string, source_file string, position long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", ARCHIVES).load(root).select("path", "content").mapInPandas(run, schema)
    day = F.regexp_extract("member", r"(\d{2}_\d{2}_\d{4})", 1)
    return rows.select(F.try_to_timestamp("timestamp").alias("timestamp"), *MEASUREMENTS, F.regexp_extract("member", r"([^/]+)\.csv$", 1).alias("series_id"), F.try_to_timestamp(day, F.lit("dd_MM_yyyy")).cast("date").alias("folder_date"), "source_file", F.lit(0).cast("long").alias("block"), "position")


def merged(rows: DataFrame) -> DataFrame:
    """One series a channel: a folder's rows up to the last instant of earlier folders go, as do unreadable instants.

    Of equal instants in one folder the first row in order of file and place stays (of rows without a place, the one with the smallest measurements).
    """
    day = F.datediff("folder_date", F.lit("1970-01-01").cast("date")).cast("long")
    before = F.max("timestamp").over(Window.partitionBy("series_id").orderBy(day).rangeBetween(Window.unboundedPreceding, -1))
    later = rows.where("timestamp IS NOT NULL").withColumn("__last", before).where("__last IS NULL OR timestamp > __last")
    w = Window.partitionBy("series_id", "timestamp").orderBy(F.col("folder_date").asc_nulls_last(), *[F.col(c) for c in ("source_file", "block", "position", *MEASUREMENTS) if c in rows.columns])
    return later.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__last")


def merge_manifest(rows: DataFrame) -> DataFrame:
    """Per channel: rows, days present and missing, dropped instants, first and last instant."""
    day = F.to_date("timestamp")
    return rows.groupBy(F.col("series_id").alias("meter_channel")).agg(F.count("timestamp").alias("n_rows"), F.countDistinct(day).alias("n_days_present"), (F.datediff(F.max(day), F.min(day)) + 1 - F.countDistinct(day)).alias("n_days_missing"), F.count_if(F.col("timestamp").isNull()).alias("n_bad_timestamp_rows_dropped"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def index_target(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(series_id, folder_date, source_file) in [start, end); more than one file of a channel and day is an error."""
    days = rows.where((F.col("folder_date") >= start) & (F.col("folder_date") < end))
    files = days.groupBy("series_id", "folder_date").agg(F.countDistinct("source_file").alias("n"), F.min("source_file").alias("source_file"))
    again = files.where("n > 1").limit(3).collect()
    if again:
        raise ValueError(f"more than one file a day: {[(r.series_id, str(r.folder_date)) for r in again]}")
    return files.drop("n")


def source_inventory(spark: SparkSession, root: str, series_id_regex: str | None = None) -> DataFrame:
    """(source_file, n_bytes, modified, series_id) of the CSV and Parquet files below ``root``; contents are not read.

    The series is the group ``series_id`` of the expression on the path, or the file's stem; null where it doesn't match.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.csv,*.parquet}").load(root)
    if series_id_regex is None:
        name = F.regexp_extract("path", r"([^/]+)\.(?:csv|parquet)$", 1)
    else:
        group = re.compile(series_id_regex).groupindex["series_id"]
        name = F.regexp_extract("path", series_id_regex.replace("(?P<", "(?<").replace("series_id>", "seriesid>"), group)
    return files.select(F.col("path").alias("source_file"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.when(name != "", name).alias("series_id"))


def training_input(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """The Parquet rows below ``root`` without manifests, if they have ``columns``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"training input lacks {missing}")
    return rows.where(~F.col("_metadata.file_name").contains("_manifest")).select(*columns)


def review_flags(spark: SparkSession, path: str, flags: Sequence[str], instants: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """A CSV of reviews as text, its flags three-valued (empty stays unknown), its instants read in ``zone`` where they name no offset."""
    rows = spark.read.option("header", True).csv(path)
    local = lambda c: F.to_utc_timestamp(F.try_to_timestamp(F.col(c)), zone)
    offset = lambda c: F.col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return rows.withColumns({c: review_flag(F.col(c)) for c in flags} | {c: F.when(offset(c), F.try_to_timestamp(F.col(c))).otherwise(local(c)) for c in instants})


#: Names of whole score files, and patterns of parts that stand in for them.
WHOLE_SCORES = ("scores_15min", "ALL_METERS_scores_15min", "ALL_SCORES_15MIN")
SCORE_PARTS = ("ALL_METERS_scores_15min_part*", "*_scores_15min")


def discover_scores(spark: SparkSession, root: str, kinds: Sequence[str] = ("csv", "parquet")) -> list[str]:
    """Score files of a folder: whole ones if there are any, else the first pattern of parts that finds some; a file is itself."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    path = Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and (fs.getFileStatus(path).isFile() or root.endswith(".parquet")):
        return [root]
    for group in (WHOLE_SCORES, *((p,) for p in SCORE_PARTS)):
        found = [s.getPath().toString() for name in group for kind in kinds for s in fs.globStatus(Path(path, f"{name}.{kind}")) or ()]
        if found:
            return list(dict.fromkeys(found if group is WHOLE_SCORES else sorted(found)))
    raise FileNotFoundError(f"no canonical scores below {root}")


def score_files(spark: SparkSession, root: str) -> DataFrame:
    """The scores that ``discover_scores`` finds, as the contract types them, with source_file; a file that lacks a column is an error."""
    out = None
    for path in discover_scores(spark, root):
        df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
        missing = missing_columns(df)
        if missing:
            raise ValueError(f"{path} lacks canonical columns: {missing}")
        typed = [parse_bool(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "boolean" else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in SCORES]
        part = df.select(*typed, F.col("_metadata.file_path").alias("source_file"))
        out = part if out is None else out.unionByName(part)
    return out


def union_scores(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Parts by name, missing columns null; a key in several parts keeps the first part's row."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__part")
    return out.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__part")


def channel_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(device, organization, channel position, id, category, rated power); position is that in the list."""
    text = spark.read.text(path, wholetext=True)
    devices = text.select(F.explode(F.from_json("value", f"map<string, struct<{METADATA.replace('organization string', 'organization:string').replace(', channels ', ',channels:')}>>")).alias("device", "d"))
    return devices.select("device", F.col("d.organization").alias("organization"), F.posexplode("d.channels").alias("position", "c")).select("device", "organization", "position", F.col("c.id").alias("id"), F.col("c.category_id").alias("category_id"), F.col("c.category_name").alias("category_name"), F.col("c.metadata.rated_power").alias("rated_power"))


def rank_mapping(metadata: DataFrame) -> DataFrame:
    """The other mapping: file index by rank of the number after the last ``C`` of the id.

    An id without such a number, or a number that a device has twice, is an error: it would shift every channel after it.
    """
    n = F.regexp_extract("id", r"C(\d+)$", 1).try_cast("int")
    ranked = metadata.withColumn("suffix", n)
    per = F.count("*").over(Window.partitionBy("device", "suffix"))
    wrong = ranked.withColumn("__n", per).where("suffix IS NULL OR __n > 1").select("device", "id").limit(3).collect()
    if wrong:
        raise ValueError(f"ids with an invalid or repeated suffix: {[tuple(r) for r in wrong]}")
    return ranked.withColumn("file_index", F.row_number().over(Window.partitionBy("device").orderBy("suffix")) - 1)


def discover(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Manifest channels with their context; status tells why one can't be used."""
    met = manifest.join(metadata, (manifest["device"] == metadata["device"]) & (manifest["channel"] == metadata["position"]), "left")
    status = F.when(metadata["device"].isNull(), "metadata_missing").when(metadata["category_id"].isNull(), "category_missing").otherwise("ready")
    return met.select(manifest["*"], metadata["organization"], metadata["category_id"], metadata["category_name"], status.alias("status"))


def usable(manifest: DataFrame, days: int = 250) -> DataFrame:
    return manifest.where((F.col("n_days_missing") == 0) & (F.col("n_days_present") >= days))


def history_and_test(history: DataFrame, test: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows of both, last one of an instant kept; status per key: ok, no_history or no_test_data)."""
    both = history.withColumn("__part", F.lit(0)).unionByName(test.withColumn("__part", F.lit(1)))
    w = Window.partitionBy(key, at).orderBy(F.desc("__part"))
    rows = both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    n = both.groupBy(key).agg(F.count_if(F.col("__part") == 0).alias("history_rows"), F.count_if(F.col("__part") == 1).alias("test_rows"))
    status = F.when(F.col("history_rows") == 0, "no_history").when(F.col("test_rows") == 0, "no_test_data").otherwise("ok")
    return rows.drop("__part"), n.withColumn("status", status)
