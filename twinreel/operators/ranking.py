"""Which copy in a group is best.

Each member gets a tier (1: close enough to the group's best, or unknown) per metric;
tiers are compared first, all four, then values, all four, then the path (smallest
wins).  Quality and size are compared within a codec, as fractions of that codec's
best.  A value that either of two members lacks is a tie for these two, so with
unknown values the order is not transitive: members are folded in path order, the
later one winning if it is better, with built-in higher-order functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.constants import LENGTH_TOLERANCE_S, METRICS, RELATIVE_TOLERANCE

MEMBER = ("media_id", "path", "codec", "duration", "resolution", "quality", "file_size", "frame_rate")


def with_figures(media: DataFrame) -> DataFrame:
    """Adds resolution, bitrate and quality; 0 where duration or frame rate is unknown."""
    out = media.withColumn("resolution", F.col("width").cast("long") * F.col("height"))
    out = out.withColumn("bitrate", F.when(F.col("duration") > 0, (F.col("file_size") * 8.0 / F.col("duration")).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("quality", F.when(F.col("frame_rate") > 0, (F.col("bitrate") / F.col("frame_rate")).cast("long")).otherwise(F.lit(0).cast("long")))


def with_maxima(members: DataFrame, *keys: str) -> DataFrame:
    """Adds the group's best duration and resolution, and its codec's best quality and size."""
    whole, same = Window.partitionBy(*keys), Window.partitionBy(*keys, "codec")
    return members.select(
        "*", F.max("duration").over(whole).alias("max_duration"), F.max("resolution").over(whole).alias("max_resolution"),
        F.max("quality").over(same).alias("max_quality"), F.max("file_size").over(same).alias("max_size"),
    )


def _within(value: str, most: str) -> Column:
    return F.when(F.col(most) == 0, F.lit(1)).otherwise((F.col(value) >= F.col(most) * F.lit(1 - RELATIVE_TOLERANCE)).cast("int"))


def tier(metric: str) -> Column:
    if metric == "length":
        return F.when(F.col("duration") <= 0, F.lit(1)).otherwise((F.col("duration") >= F.col("max_duration") - LENGTH_TOLERANCE_S).cast("int"))
    if metric == "resolution":
        return _within("resolution", "max_resolution")
    if metric == "quality":
        return F.when((F.col("frame_rate") <= 0) | (F.col("duration") <= 0), F.lit(1)).otherwise(_within("quality", "max_quality"))
    return _within("file_size", "max_size")


def with_tiers(members: DataFrame, *keys: str) -> DataFrame:
    """Adds the maxima over `keys` and tier_<metric>."""
    out = with_maxima(members, *keys)
    return out.select("*", *[tier(m).alias(f"tier_{m}") for m in METRICS])


def ordered_metrics(priority: str) -> list[str]:
    if priority not in METRICS:
        raise ValueError(f"priority must be one of {', '.join(METRICS)}")
    return [priority, *(m for m in METRICS if m != priority)]


def _values(a: Column, b: Column, metric: str) -> tuple[Column, Column, Column]:
    """(comparable, value of a, value of b)."""
    timed = (a["duration"] > 0) & (b["duration"] > 0)
    wide = lambda x: x.cast("decimal(19,0)")
    if metric == "length":
        return timed, F.floor(a["duration"] * 1000), F.floor(b["duration"] * 1000)
    if metric == "resolution":
        return F.lit(True), a["resolution"], b["resolution"]
    if metric == "quality":
        return timed & (a["frame_rate"] > 0) & (b["frame_rate"] > 0), wide(a["quality"]) * wide(b["max_quality"]), wide(b["quality"]) * wide(a["max_quality"])
    return F.lit(True), wide(a["file_size"]) * wide(b["max_size"]), wide(b["file_size"]) * wide(a["max_size"])


def better(a: Column, b: Column, priority: str) -> Column:
    """Is member a ranked above member b?"""
    out = a["path"] < b["path"]
    order = ordered_metrics(priority)
    for m in reversed(order):
        able, x, y = _values(a, b, m)
        out = F.when(able & (x != y), x > y).otherwise(out)
    for m in reversed(order):
        out = F.when(a[f"tier_{m}"] != b[f"tier_{m}"], a[f"tier_{m}"] > b[f"tier_{m}"]).otherwise(out)
    return out


def find_best(tiered: DataFrame, priority: str, *keys: str) -> DataFrame:
    """(keys, best): the best member's media_id; `tiered` has tiers and maxima already."""
    fields = [*MEMBER, "max_quality", "max_size", *(f"tier_{m}" for m in METRICS)]
    listed = tiered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", *[f for f in fields if f != "path"]))).alias("m"))
    best = F.aggregate(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))), F.col("m")[0], lambda acc, x: F.when(better(x, acc, priority), x).otherwise(acc))
    return listed.select(*keys, best["media_id"].alias("best"))
