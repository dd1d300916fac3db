"""Command line: scan and compare, or replay a report."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinreel.constants import METRICS
from twinreel.functions.hashing import median_hash
from twinreel.operators import dispose as disposal
from twinreel.operators import report as reporting
from twinreel.operators import samples as sampling
from twinreel.operators import stats
from twinreel.operators.cache import Cache, lookup, prune_obstacle
from twinreel.operators.coverage import check_knobs
from twinreel.operators.decide import reclaimable
from twinreel.plans.api import Result, find_duplicates
from twinreel.plans.storage import settle
from twinreel.sources import files, reports
from twinreel.sources.decoders import fingerprint
from twinreel.streaming.ingest import entries, frames_of


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinreel", description="Find near-duplicate media and clips.")
    a = p.add_argument
    a("paths", nargs="*")
    a("-e", "--exclude", action="append", default=[])
    a("--from-file")
    a("-0", "--null", action="store_true")
    a("-r", "--recursive", action="store_true")
    a("--follow-symlinks", action="store_true")
    a("-x", "--extensions")
    a("-d", "--distance", type=int, default=4)
    a("-p", "--percent", type=float, default=20.0)
    a("--min-duration", type=float, default=0.0)
    a("--keyframe-interval", type=float, default=0.0)
    a("--min-keyframes", type=float, default=12.0)
    a("-k", "--priority", choices=METRICS, default="length")
    a("-o", "--output")
    a("--format", choices=("csv", "json", "txt"))
    a("--delete", action="store_true")
    a("--permanent", action="store_true")
    a("--move-to")
    a("--from-report")
    a("-y", "--yes", action="store_true")
    a("--cache")
    a("--clear-cache", action="store_true")
    a("--prune-cache", action="store_true")
    a("-q", "--quiet", action="store_true")
    a("-t", "--threads", type=int, default=0)
    return p


def media_and_samples(frames: DataFrame, interval: float, min_keyframes: float) -> tuple[DataFrame, DataFrame]:
    """The model's tables from decoded frames: clock, sub-sampling, times, collapse, spans."""
    ids = frames.where("seq IS NOT NULL").select("path").distinct().select("path", F.xxhash64("path").alias("media_id"))
    rows = frames.where("seq IS NOT NULL").join(ids, "path")
    clock = sampling.sample_clock(rows.where("t IS NOT NULL").select("media_id", "seq", F.col("t").alias("ts"), "duration"))
    every = sampling.effective_interval(F.col("duration"), interval, min_keyframes) * 1000
    kept = sampling.subsample(clock, every).select("media_id", "seq", F.col("elapsed").alias("kept"))
    timed = rows.join(kept, ["media_id", "seq"], "left").where("kept IS NOT NULL OR t IS NULL").withColumn("t", F.coalesce("kept", "t"))
    times = sampling.sample_times(timed).withColumn("hash", median_hash(F.col("coefficients")))
    spans = sampling.spans(sampling.collapse(times))
    per = times.groupBy("media_id").agg(*[F.first(c).alias(c) for c in ("path", "total_ms", "duration", "width", "height", "codec", "frame_rate", "file_size")])
    media = per.withColumn("duration", sampling.first_positive(F.col("duration"))).withColumn("frame_rate", sampling.plausible_rate(F.col("frame_rate")))
    return media, spans.select("media_id", "idx", "hash", "t_start", "t_end")


def decoded(spark: SparkSession, paths: list[str], cache: Cache | None, args: argparse.Namespace) -> DataFrame:
    """The frames of the files; with a cache, only files that it does not know as they are now are opened."""

    def load(some: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(some).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))

    if cache is None:
        return settle(fingerprint(load(paths)), "frames")
    known = cache.read()
    missing = paths
    if known is not None:
        # the stamps come from the listing; contents are not read
        now = load(paths).select(
            "path", F.unix_seconds("modificationTime").alias("mtime"), (F.unix_micros("modificationTime") % 1_000_000 * 1000).alias("mtime_nsec"), F.col("length").alias("size"),
            F.lit(args.keyframe_interval).alias("kf_interval"), F.lit(args.min_keyframes).alias("min_kf_samples"),
        )
        missing = [r["path"] for r in lookup(now, known).where("status = 'miss'").select("path").toLocalIterator()]
    if missing:
        cache.upsert(settle(entries(load(missing), args.keyframe_interval, args.min_keyframes), "entries"))
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    return settle(frames_of(cache.read().join(wanted, "path", "left_semi")), "frames")


def scan(spark: SparkSession, args: argparse.Namespace, cache: Cache | None = None) -> tuple[Result | None, DataFrame | None, files.Library]:
    wanted = files.normalize_extensions(args.extensions) if args.extensions else list(files.EXTENSIONS) + ["y4m", "pgm"]
    library = files.collect(files.requested_paths(args.paths, args.from_file, args.null), args.recursive, wanted, args.exclude, args.follow_symlinks)
    if args.move_to and files.walk_reaches(library.roots, os.path.realpath(args.move_to), map(os.path.realpath, args.exclude)):
        raise ValueError("the destination is inside a scanned folder")
    if not library.files:
        return None, None, library
    frames = decoded(spark, [f[0] for f in library.files], cache, args)
    problems = frames.where("problem IS NOT NULL").select(F.lit("unusable file").alias("category"), F.monotonically_increasing_id().alias("seq"), F.concat_ws(": ", "path", "problem").alias("detail"))
    media, samples = media_and_samples(frames, args.keyframe_interval, args.min_keyframes)
    return find_duplicates(media, samples, args.distance, args.percent, args.min_duration, args.priority), problems, library


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, began = parser().parse_args(argv), time.monotonic()
    try:
        check_knobs(args.distance, args.percent, args.min_duration, args.keyframe_interval, args.min_keyframes)
    except ValueError as e:
        print(e, file=sys.stderr)
        return stats.EXIT_FAILED
    if args.output:
        try:
            reporting.check_output(args.output)
        except OSError as e:
            print(e, file=sys.stderr)
            return stats.EXIT_FAILED
    how = disposal.disposal_for(args.delete, args.permanent, args.move_to)
    if spark is None:
        spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").appName("twinreel").getOrCreate()
    cache = Cache(spark, args.cache) if args.cache else None
    if cache and args.clear_cache:
        cache.clear()
    if args.from_report:
        rows = reports.verdicts(reports.read_report(spark, args.from_report))
        targets = [(r["full_path"], int(r["bytes"])) for r in rows.where("verdict = 'delete'").orderBy("row_no").toLocalIterator()]
        if how is None or not disposal.approve(targets, how, interactive=sys.stdin.isatty(), assume_yes=args.yes):
            return stats.EXIT_FAILED
        _, tally = disposal.dispose(targets, how)
        return stats.exit_code(rows.where("verdict = 'unusable'").count() + tally["FAILED"] + tally["CHANGED"])
    result, problems, library = scan(spark, args, cache)
    if cache and args.prune_cache:
        obstacle = prune_obstacle(library.problems, len(library.files))
        if obstacle:
            print(f"cache not pruned: {obstacle}", file=sys.stderr)
        else:
            cache.prune(spark.createDataFrame([(f[0],) for f in library.files], "path string"))
    trouble = sum(library.problems.values())
    if result is None:
        if args.output:
            head = iter([";".join(reporting.REPORT_COLUMNS) + "\n"]) if reporting.format_for(args.output, args.format) == "csv" else iter([])
            reporting.write_atomically(args.output, head)
        return stats.exit_code(trouble)
    tallied = stats.tally(problems.unionByName(result.problems))
    trouble += tallied.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    done = None
    if how is not None:
        doomed = result.members.join(result.fates.where("action = 'DELETE'"), "media_id").select("path", "file_size").distinct().orderBy("path")
        targets = [(r["path"], r["file_size"]) for r in doomed.toLocalIterator()]
        if disposal.approve(targets, how, interactive=sys.stdin.isatty(), assume_yes=args.yes):
            outcomes, done = disposal.dispose(targets, how)
            trouble += done["FAILED"] + done["CHANGED"]
            ended = spark.createDataFrame(outcomes or [("", "")], "path string, outcome string")
            result.detail = result.detail.join(ended, "path", "left").withColumn("action", F.when(F.col("action") == "DELETE", F.coalesce("outcome", F.lit("SKIPPED"))).when(F.col("action") == "KEEP", "KEPT").otherwise(F.col("action"))).drop("outcome")
            result.report = reporting.text_rows(result.detail)
    if args.output:
        groups = found = None
        if reporting.format_for(args.output, args.format) == "json":
            groups = reporting.json_groups(result.detail, result.links)
            found = reporting.summary(reclaimable(result.members, result.fates).first(), how.mode if done is not None else "report", how.to if done is not None and how.mode == "move" else None, done, int(time.monotonic() - began))
        reporting.write_report(result.report, args.output, args.format, groups, found)
    elif not args.quiet:
        sys.stdout.writelines(reporting.listing_text(result.report))
    for line in [] if args.quiet else stats.summary_lines(tallied):
        print(line, file=sys.stderr)
    return stats.exit_code(trouble)


if __name__ == "__main__":
    sys.exit(main())
