"""How much of each medium a match covers, which pairs pass, and the links of a medium."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f32_ratio(part: Column, whole: Column) -> Column:
    """Single-precision quotient of two whole numbers."""
    return (part.cast("float") / whole.cast("float")).cast("float")


def _side(marks: DataFrame, samples: DataFrame, medium: str, idx: str) -> DataFrame:
    at = samples.select(F.col("media_id").alias(medium), F.col("idx").alias(idx), "t_start", "t_end")
    per = marks.select("a", "b", idx).distinct().join(at, [medium, idx]).groupBy("a", "b")
    return per.agg(F.sum(F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0))).alias("ms"), F.min_by("t_start", idx).alias("start_ms"), F.max_by("t_end", idx).alias("end_ms"))


def coverage(marks: DataFrame, samples: DataFrame, media: DataFrame) -> DataFrame:
    """(a, b, ms_a, ms_b, coverage_a, coverage_b, span_a, span_b): covered time and its envelope, per pair and side."""
    out = None
    for side, medium, idx in (("a", "a", "i"), ("b", "b", "j")):
        total = media.select(F.col("media_id").alias(medium), F.col("total_ms").alias("total"))
        one = _side(marks, samples, medium, idx).join(total, medium)
        ratio = F.when(F.col("total") > 0, F.least(f32_ratio(F.col("ms"), F.col("total")), F.lit(1.0).cast("float"))).otherwise(F.lit(0.0).cast("float"))
        one = one.select("a", "b", F.col("ms").alias(f"ms_{side}"), ratio.alias(f"coverage_{side}"), F.struct("start_ms", "end_ms").alias(f"span_{side}"))
        out = one if out is None else out.join(one, ["a", "b"])
    return out


def percent_gate(pairs: DataFrame, percent: float) -> DataFrame:
    """Pairs in which either side is covered enough; a pair that shares nothing never passes."""
    best = F.greatest("coverage_a", "coverage_b")
    return pairs.where((best > 0) & (best >= F.lit(percent).cast("float") / F.lit(100.0).cast("float")))


def overlap_seconds(coverage_a: Column, duration_a: Column, coverage_b: Column, duration_b: Column) -> Column:
    """The lower estimate of the shared time; null if neither runtime is known."""
    one = lambda c, d: F.when(d > 0, c.cast("double") * d)
    return F.least(one(coverage_a, duration_a), one(coverage_b, duration_b))


def seconds_gate(pairs: DataFrame, media: DataFrame, least: float) -> DataFrame:
    """Pairs that share at least so many seconds, by their own `duration_a` and `duration_b` or else those of the media; 0 turns the gate off."""
    if not least > 0:
        return pairs
    if "duration_a" in pairs.columns:
        shared = overlap_seconds(F.col("coverage_a"), F.col("duration_a"), F.col("coverage_b"), F.col("duration_b"))
        return pairs.where(shared >= least).drop("duration_a", "duration_b")
    a = media.select(F.col("media_id").alias("a"), F.col("duration").alias("_da"))
    b = media.select(F.col("media_id").alias("b"), F.col("duration").alias("_db"))
    shared = overlap_seconds(F.col("coverage_a"), F.col("_da"), F.col("coverage_b"), F.col("_db"))
    return pairs.join(a, "a").join(b, "b").where(shared >= least).drop("_da", "_db")


def links(matches: DataFrame) -> DataFrame:
    """(subject, other, coverage, span, and duration where matches have it): every match seen from both sides, in one reading of the matches."""
    own = [c for c in ("coverage", "span", "duration") if f"{c}_a" in matches.columns]
    one = lambda x, y: F.struct(F.col(x).alias("subject"), F.col(y).alias("other"), *[F.col(f"{c}_{x}").alias(c) for c in own])
    return matches.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("l")).select("l.*")


def runtime_filter(media: DataFrame, least: float) -> DataFrame:
    """Media that are not known to be shorter than `least` seconds."""
    return media.where(~((F.lit(least) > 0) & (F.col("duration") > 0) & (F.col("duration") < least)))


def check_knobs(distance: int, percent: float, min_duration: float, keyframe_interval: float = 0.0, min_keyframes: float = 12.0) -> None:
    """Refuse settings that make no sense, before any work."""
    import math

    if not 0 <= distance <= 32:
        raise ValueError("distance must be between 0 and 32")
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    if not min_duration >= 0:
        raise ValueError("min_duration must not be negative")
    for name, x in (("keyframe_interval", keyframe_interval), ("min_keyframes", min_keyframes)):
        if not math.isfinite(x) or x < 0:
            raise ValueError(f"{name} must be finite and not negative")
