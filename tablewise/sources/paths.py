"""Where intermediate tables go, and when they go away."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders of the frames that ``stored`` gave out.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-tablewise-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    in local mode, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/tablewise-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to scratch and read back, which cuts the lineage: a later stage never recomputes what
    stands before, whatever executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def small(df: DataFrame) -> DataFrame:
    """A frame with a row a column or table, held by the driver and so computed only once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of frames from ``stored`` that nothing lazy reads any more."""
    for df in frames:
        path = _FOLDERS.pop(df, None) if df is not None else None
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
