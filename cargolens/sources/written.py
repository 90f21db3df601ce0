"""Tables written between the steps of an iterative job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: folders of local sessions that name none, by application
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cargolens-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the application ends."""
    path = f"{shared_folder(spark)}/written/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written there and read back, so that a lost executor costs no more than what it holds."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """These columns of df, written: what several aggregates need of a costly view, so that the view is read once."""
    return written(df.select(*dict.fromkeys(columns)), "once", "zstd")
