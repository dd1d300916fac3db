"""Shared helpers: shared-storage tables, bounded Arrow batches, text normalisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows handed to a Python worker at once (texts can be long).
ARROW_ROWS = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_root: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or on a local master (tests) a temporary one where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="twinreel-")
    return _own_root[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet to shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        delete_path(df.sparkSession, files[0].rsplit("/", 1)[0])


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone; shared folders are swept by their owner
            return


_batch_rows: dict[int, int] = {}


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches of at most `rows` rows from now on, and never more than the session first had: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    first = _batch_rows.setdefault(id(spark._jsparkSession), int(spark.conf.get(key, "10000")))
    spark.conf.set(key, str(min(first, rows) if first > 0 else rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched; ASCII-only texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body` (a lambda binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """Each row as one column `row`, and further columns that no column of the caller's can clash with."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), *(v.alias(k) for k, v in extra.items()))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))
