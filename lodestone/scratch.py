"""Shared-folder tables that cut lineage: the folder is the cluster's ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone import errors

_own: dict[str, str] = {}
_written: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; a temporary one only where none is set (local tests).

    On a cluster an executor's own disk is no such folder: without one that is named, this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise errors.InvalidAlgorithmParameter("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(_own[app])
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has written and not dropped: when no result is read any more."""
    for path in list(_written):
        _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
