"""Tables that a job saves on its way, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where the setting is missing on one machine, as in tests, it is set to a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def removed(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def until_exit(spark: SparkSession, folder: str) -> str:
    """folder, which goes when the application ends."""
    files, path = _files(spark, folder)
    files.deleteOnExit(path)
    return folder


def _written(df: DataFrame, folder: str, by: list[str] | None = None) -> DataFrame:
    (df.write.partitionBy(*by) if by else df.write).parquet(folder)
    fields = [f for f in df.schema.fields if f.name not in (by or [])] + [df.schema[c] for c in by or []]
    schema = type(df.schema)(fields)
    return df.sparkSession.read.schema(schema).parquet(folder)


def saved(df: DataFrame) -> DataFrame:
    """df written and read again; its lineage ends there. It stays until the application ends."""
    return _written(df, until_exit(df.sparkSession, shared_folder(df.sparkSession)))


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Inside, the function given saves tables (df, and columns to lay files out by); all of them are removed at the end."""
    own = shared_folder(spark)
    try:
        yield lambda df, by=None: _written(df, f"{own}/{uuid.uuid4().hex}", by)
    finally:
        removed(spark, own)
