"""Tables written to shared storage to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or on a local master (tests) a temporary folder where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/") if named else _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="twinreel-"))


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, key: str, parts: int, name: str) -> dict[int, list[str]]:
    """The files of each value of a column of whole numbers below `parts`, for tasks that read some of them."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.repartitionById(parts, key).write.partitionBy(key).parquet(path)
    out: dict[int, list[str]] = {}
    for file in df.sparkSession.read.schema(df.schema).parquet(path).inputFiles():
        out.setdefault(int(re.search(f"/{key}=([0-9]+)/[^/]*$", file)[1]), []).append(file)
    return out


def open_shared(file: str) -> pa.NativeFile:
    if file.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(unquote(re.sub("^file:/+", "/", file)))
    fs, path = pafs.FileSystem.from_uri(file)
    return fs.open_input_file(path)


def task_readable(spark: SparkSession) -> bool:
    """Whether tasks can open files of the shared store themselves: local (shared) folders, and stores that pyarrow knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if uri.startswith("file:"):
        return True
    try:
        pafs.FileSystem.from_uri(uri)
    except Exception:  # an unknown scheme, or a store whose library is absent
        return False
    return True


def drop(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
