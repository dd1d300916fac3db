"""From timestamps and frames to samples: clock, sub-sampling, collapse, spans, sample times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.constants import MOST_FRAME_RATE


def sample_clock(frames: DataFrame) -> DataFrame:
    """Adds `elapsed` and `restarted` to frames(media_id, seq, ts): a clock that never runs back.

    Forward gaps add up; a step back adds the last forward gap instead (at least 1).
    """
    w = Window.partitionBy("media_id").orderBy("seq")
    gap = F.col("ts") - F.lag("ts").over(w)
    last = F.last(F.when(F.col("_gap") > 0, F.col("_gap")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stepped = frames.withColumn("_gap", gap).withColumn("_step", F.when(F.col("_gap").isNull(), 0).when(F.col("_gap") >= 0, F.col("_gap")).otherwise(F.greatest(F.coalesce(last, F.lit(1)), F.lit(1))))
    return stepped.withColumn("elapsed", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("restarted", F.coalesce(F.col("_gap") < 0, F.lit(False))).drop("_gap", "_step")


def effective_interval(duration: Column, interval: float, min_keyframes: float) -> Column:
    """Seconds between kept keyframes: the interval, shortened so that a short file keeps enough; 0 keeps all."""
    floor = duration / min_keyframes if min_keyframes > 0 else F.lit(float("inf"))
    return F.when((F.lit(interval) > 0) & (duration > 0), F.least(F.lit(float(interval)), floor)).otherwise(0.0)


def subsample(frames: DataFrame, interval_ms: Column) -> DataFrame:
    """(media_id, seq, elapsed) of the frames kept: each is at least the interval after the last one kept.

    Which frame is kept depends on the last kept, so each medium's frames are folded in order.
    """
    state = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<seq:bigint,elapsed:bigint>>").alias("kept"))
    item = lambda x: F.struct(x["seq"].cast("long").alias("seq"), x["elapsed"].cast("long").alias("elapsed"))
    listed = frames.withColumn("_every", interval_ms).groupBy("media_id").agg(F.max("_every").alias("every"), F.array_sort(F.collect_list(F.struct("seq", "elapsed"))).alias("fs"))
    folded = F.aggregate(
        "fs", state,
        lambda a, x: F.when(a["last"].isNull() | (F.col("every") <= 0) | (x["elapsed"] - a["last"] >= F.col("every")), F.struct(x["elapsed"].cast("long").alias("last"), F.concat(a["kept"], F.array(item(x))).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return listed.select("media_id", F.explode(folded).alias("k")).select("media_id", "k.seq", "k.elapsed")


def drop_repeats(frames: DataFrame, content: str) -> DataFrame:
    """Frames that differ from the one before."""
    w = Window.partitionBy("media_id").orderBy("seq")
    before = frames.withColumn("_before", F.lag(content).over(w)).withColumn("_n", F.row_number().over(w))
    return before.where((F.col("_n") == 1) | ~F.col(content).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def collapse(samples: DataFrame) -> DataFrame:
    """First sample of each run of equal (hash, valid), by time, then seq."""
    w = Window.partitionBy("media_id").orderBy("t_start", "seq")
    state = F.struct("hash", "valid")
    marked = samples.withColumn("_state", state).withColumn("_before", F.lag(state).over(w))
    return marked.where(F.col("_before").isNull() | (F.col("_state") != F.col("_before"))).drop("_state", "_before")


def spans(changes: DataFrame, total_ms: str = "total_ms") -> DataFrame:
    """Adds t_end and drops what is not valid: a sample lasts to the next change of any kind, the last to the end.

    The next change is found before featureless samples go, so they do not lengthen their neighbours.
    """
    w = Window.partitionBy("media_id").orderBy("t_start", "seq")
    ended = changes.withColumn("t_end", F.coalesce(F.lead("t_start").over(w), F.col(total_ms)))
    kept = ended.where("valid")
    return kept.withColumn("idx", F.row_number().over(w) - 1)


def sample_times(samples: DataFrame, duration: str = "duration") -> DataFrame:
    """Adds t_start and total_ms to samples(media_id, seq, t, duration).

    If any time is unknown all are spread evenly over the runtime.  A runtime that the samples outrun is
    the last time and one average gap.
    """
    w = Window.partitionBy("media_id")
    pos = F.row_number().over(w.orderBy("seq")) - 1
    base = samples.select("*", pos.alias("_pos"), F.count("*").over(w).alias("_n"), F.count("t").over(w).alias("_known"), F.when(F.col(duration) > 0, F.floor(F.col(duration) * 1000)).otherwise(0).alias("_total"))
    base = base.withColumn("_total", F.when((F.col("_known") < F.col("_n")) & (F.col("_total") == 0), F.col("_n")).otherwise(F.col("_total")))
    timed = base.withColumn("t_start", F.when(F.col("_known") == F.col("_n"), F.col("t")).otherwise(F.expr("_pos * _total div _n")).cast("long"))
    last = timed.withColumn("_last", F.max("t_start").over(w))
    gap = F.greatest(F.expr("_last div greatest(_n - 1, 1)"), F.lit(1))
    return last.withColumn("total_ms", F.when(F.col("_total") <= F.col("_last"), F.col("_last") + gap).otherwise(F.col("_total")).cast("long")).drop("_pos", "_n", "_known", "_total", "_last")


def runtime(duration: Column, total_ms: Column, restarted: Column) -> Column:
    """A file whose clock restarted lasts at least as long as its samples."""
    return F.when(restarted, F.greatest(duration, total_ms / 1000.0)).otherwise(duration)


def plausible_rate(fps: Column) -> Column:
    ok = ~F.isnan(fps) & (fps > 0) & (fps <= MOST_FRAME_RATE)
    return F.when(F.coalesce(ok, F.lit(False)), fps).otherwise(0.0)


def rational(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / denominator)


def first_positive(*durations: Column) -> Column:
    """The first runtime that is known: the stream's, then the container's; 0 if none."""
    return F.coalesce(*[F.when(d > 0, d.cast("double")) for d in durations], F.lit(0.0))
