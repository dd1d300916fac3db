"""Problem tallies, decode weights and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.constants import CODEC_COST, COST_PER_BYTE, SAMPLES_PER_PROBLEM, SECONDS_PER_KEYFRAME, TRANSIENT_ERRNO

#: A job is never given more threads than this.
MOST_THREADS = 16
EXIT_OK, EXIT_FAILED, EXIT_PROBLEMS, EXIT_INTERRUPTED = 0, 1, 2, 130


def tally(problems: DataFrame, most: int = SAMPLES_PER_PROBLEM) -> DataFrame:
    """(category, count, samples): all are counted, the first `most` by `seq` are kept.

    The top rows are taken by a ranked limit before they are gathered, so no list holds a whole category.
    """
    w = Window.partitionBy("category").orderBy("seq")
    counts = problems.groupBy("category").agg(F.count("*").alias("count"))
    first = problems.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    kept = first.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "detail"))), lambda x: x["detail"]).alias("samples"))
    return counts.join(kept, "category")


def summary_lines(tallied: DataFrame) -> list[str]:
    lines = []
    for r in tallied.orderBy("category").toLocalIterator():
        lines.append(f"{r['category']}: {r['count']}")
        lines += [f"  {x}" for x in r["samples"]]
        if r["count"] > len(r["samples"]):
            lines.append(f"  ... and {r['count'] - len(r['samples'])} more")
    return lines


def exit_code(problems: int, failed: bool = False, interrupted: bool = False) -> int:
    return EXIT_INTERRUPTED if interrupted else EXIT_FAILED if failed else EXIT_PROBLEMS if problems else EXIT_OK


def codec_cost(codec: Column) -> Column:
    out = F.lit(1.0)
    for name, cost in CODEC_COST.items():
        out = F.when(codec == name, cost).otherwise(out)
    return out


def decode_weight(keyframes: Column, pixels: Column, duration: Column, codec: Column, size: Column, interval: float = 0.0, min_keyframes: float = 0.0) -> Column:
    """Work to decode a file: keyframes x pixels x codec cost; keyframes from the runtime, or all from the bytes, where unknown."""
    guess = F.greatest(F.ceil(duration / SECONDS_PER_KEYFRAME), F.lit(1))
    n = F.when(keyframes > 0, keyframes).when(duration > 0, guess)
    if interval > 0:
        floor = duration / min_keyframes if min_keyframes > 0 else F.lit(float("inf"))
        every = F.least(F.lit(float(interval)), floor)
        n = F.when((duration > 0) & (every > 0), F.least(n, F.greatest(F.ceil(duration / F.when(every > 0, every)), F.lit(1)))).otherwise(n)
    work = F.floor(F.greatest(n.cast("double") * pixels * codec_cost(codec), F.lit(1.0)))
    return F.coalesce(F.when((pixels > 0) & n.isNotNull(), work), F.greatest(F.floor(size * COST_PER_BYTE), F.lit(1))).cast("long")


def thread_share(weight: Column, queued: Column, free: Column) -> Column:
    """Threads for a job of this weight, out of `free`, with `queued` weight still waiting; never 1 where it is owed more than 1."""
    most = F.least(free, F.lit(MOST_THREADS))
    exact = free * weight.cast("double") / (weight.cast("double") + queued.cast("double"))
    near = F.floor(exact + 0.5)
    share = F.when(exact > 1, F.greatest(near, F.lit(2))).otherwise(near)
    return F.when(free == 0, 0).when(queued == 0, most).otherwise(F.least(F.greatest(share, F.lit(1)), most)).cast("int")


def active_threads(requested: int, cores: int) -> int:
    cores = max(cores, 1)
    return min(requested, max(4 * cores, 16)) if requested else cores


def is_transient(errno_: Column) -> Column:
    return F.coalesce(errno_.isin(list(TRANSIENT_ERRNO)), F.lit(True))


def packed(files: DataFrame, bins: int) -> DataFrame:
    """Files dealt to `bins` partitions of about equal weight: heaviest first, there and back."""
    at = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("path"), F.lit(bins))).orderBy(F.desc("weight"), "path")) - 1
    lane = F.pmod(F.xxhash64("path"), F.lit(bins))
    turn = F.pmod(at * 7919 + lane, F.lit(bins))
    return files.withColumn("_bin", turn.cast("int")).repartition(bins, "_bin").drop("_bin")
