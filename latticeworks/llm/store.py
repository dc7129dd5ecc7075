"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset in a local session, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder of one run under the shared one; put() cuts the lineage of a table by writing it there."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the whole folder, once nothing reads it any more."""
        self.drop("")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; what does not exist is no error."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Of a folder's URI, for tasks that write or read byte files beside Spark's tables: local, s3a, hdfs, viewfs or gs."""
    scheme, found, rest = uri.partition(":/")
    if not found:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3", "s3a", "s3n"):
        return pafs.S3FileSystem(), rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, chunks) -> tuple[str, int]:
    """Writes chunks to a file whose name no other attempt has; returns its URI and size.

    Readers know a file by the URI in a table that Spark commits, so what a lost or repeated attempt leaves behind is never read.
    """
    folder, _, name = uri.rpartition("/")
    stem, dot, ext = name.partition(".")
    own = f"{folder}/{stem}-{uuid.uuid4().hex}{dot}{ext}"
    fs, path = filesystem(own)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:  # not by the extension
        for chunk in chunks:
            size += len(chunk)
            out.write(chunk)
    return own, size
