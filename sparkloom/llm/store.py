"""Where operators keep tables and files that outlive a task: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables kept in each open scope of this thread or task, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Rows sent to a Python worker at once while a table is written: texts are a few kB, and JVM and worker each hold a batch.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the setting is unset, a local-mode session gets a folder of this machine; a cluster is an error, as its executors could not see one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """path goes with the application at the latest: a result may read it until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def kept(df: DataFrame, kind: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors.

    The table is removed with the scope around, or with the application.
    """
    spark = df.sparkSession
    path = new_dir(spark, kind)
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    until_exit(spark, path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables kept inside are removed at the end, but for those put into the yielded list, which pass to the scope around."""
    own: list[str] = []
    stay: list[DataFrame] = []
    around = _scopes.get()
    token = _scopes.set((*around, own))
    try:
        yield stay
    finally:
        _scopes.reset(token)
        for path in own:
            if path not in {df.kept_path for df in stay}:
                removed(spark, path)
            elif around:
                around[-1].append(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """df with a struct that differs from row to row and is never null.

    Rows of a plain table of Parquet files are told apart by file and place, at no cost; any other df is written first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
        except AnalysisException:  # another format, without row numbers
            pass
    placed = kept(df.withColumn("_place", F.monotonically_increasing_id()), "rows")
    return placed.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.col("_place").alias("place"))).drop("_place")
