"""Reading reports back, and what each of their rows asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.constants import ACTIONS


def looks_like_json(head: str) -> bool:
    """Is the first character that is not blank, within 64, an opening brace or bracket?"""
    return head[:64].lstrip()[:1] in ("{", "[")


def _named(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c.strip().lower() == name:
            return c
    raise ValueError(f"the report has no '{name}' column")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, action, full_path, size_bytes) as text; columns are found by name, rows may be short or long."""
    raw = spark.read.csv(path, sep=";", header=True, mode="PERMISSIVE", multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select(F.monotonically_increasing_id().alias("row_no"), *[F.coalesce(F.col(f"`{_named(raw, c)}`"), F.lit("")).alias(c) for c in ("action", "full_path", "size_bytes")])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from results[].files[]; figures are read as text."""
    schema = "results array<struct<files: array<struct<action: string, full_path: string, size_bytes: string>>>>"
    raw = spark.read.json(path, schema=schema, multiLine=True)
    one = raw.select(F.posexplode("results").alias("g", "r")).select("g", F.posexplode("r.files").alias("f", "x"))
    blank = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c)
    return one.select((F.col("g").cast("long") * (1 << 32) + F.col("f")).alias("row_no"), blank("action"), blank("full_path"), blank("size_bytes"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 64)).first()
    return (read_json if head and looks_like_json(head[0]) else read_csv)(spark, path)


def canonical_fault(path: Column) -> Column:
    """Why a path is not one that a report writes; null if it is."""
    return F.when(~F.startswith(path, F.lit("/")), "is not an absolute path").when(F.array_contains(F.split(path, "/"), ".."), 'contains a ".." component')


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds `verdict` (delete, ignore, repeat, unusable), `reason` and `bytes` to report rows.

    Cells are trimmed, except the path.  Of rows that name a path to delete, the first counts.
    """
    action, size = F.lower(F.trim("action")), F.trim("size_bytes")
    digits = F.regexp_replace(size, r"^\+", "")
    parsed = F.when(size.rlike(r"^\+?[0-9]+$"), F.try_to_number(F.lpad(digits, 38, "0"), F.lit("9" * 38)))
    parsed = F.when(parsed < F.lit(str(2**64)).cast("decimal(38,0)"), parsed)
    fault = canonical_fault(F.col("full_path"))
    reason = (
        F.when(action == "", F.lit(None)).when(~action.isin(list(ACTIONS)), "action").when(action != "delete", F.lit(None))
        .when(F.trim("full_path") == "", "no full_path").when(fault.isNotNull(), fault).when(parsed.isNull(), "unusable size_bytes")
    )
    judged = rows.withColumn("reason", reason).withColumn("bytes", parsed).withColumn("_go", (action == "delete") & F.col("reason").isNull())
    first = F.row_number().over(Window.partitionBy("full_path", "_go").orderBy("row_no"))
    verdict = F.when(F.col("reason").isNotNull(), "unusable").when(~F.col("_go"), "ignore").when(first > 1, "repeat").otherwise("delete")
    return judged.withColumn("verdict", verdict).withColumn("bytes", F.when(F.col("verdict") == "delete", F.col("bytes"))).drop("_go")
