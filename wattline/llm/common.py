"""Tables, scratch storage and session helpers shared by the operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular-expression class of the ASCII white space that separates words.
WS = "[\\x20\\x09-\\x0D]"

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="wattline-")
    return _OWN["dir"]


#: Setting by which Spark deletes a query's shuffle files when the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind; the session's own setting returns afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Intermediate tables in the shared folder.

    ``put`` writes a frame and returns a frame that reads it, which cuts lineage:
    a lost executor costs only the tasks that read the table again.  Operators return
    frames that read their scratch tables; ``made`` and ``clear_scratch`` let a caller
    delete them once a result is consumed.
    """

    #: Roots of all scratch spaces that are not deleted yet, oldest first.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        with freed_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Delete all tables of this scratch space, once nothing reads them any more."""
        self.drop("")
        if self in Scratch.made:
            Scratch.made.remove(self)


def clear_scratch(since: int = 0, keep: tuple[Scratch, ...] = ()) -> None:
    """Delete the scratch spaces made since there were ``since`` of them, but those in ``keep``."""
    for space in [s for s in Scratch.made[since:] if s not in keep]:
        space.close()


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    bare = F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{WS}+"))).cast("long")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    held = sys.modules.setdefault("_wattline_worker_cache", types.ModuleType("_wattline_worker_cache"))
    return held.__dict__.setdefault("items", {})
