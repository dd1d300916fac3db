"""Fingerprint cache: Parquet, one folder for each version of the algorithm, replaced as a whole.

Readers follow a pointer file, so a run that dies half way leaves the old table in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = ("mtime", "mtime_nsec", "size", "kf_interval", "min_kf_samples")
#: Named anew whenever the meaning of what is stored changes.
VERSION = "v1"


def _same(a: Column, b: Column) -> Column:
    return (a == b) | (F.isnan(a) & F.isnan(b))


def _off(x: Column) -> Column:
    """Zero, negative and NaN all mean that a setting is off."""
    return F.isnan(x) | (x <= 0)


def stamp_matches(a: str, b: str) -> Column:
    """Do stamps a.* (kept) and b.* (now) say the same file, sampled alike?  The floor matters only while sampling is on."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    sampling = (_off(x("kf_interval")) & _off(y("kf_interval"))) | (~_off(x("kf_interval")) & ~_off(y("kf_interval")) & _same(x("kf_interval"), y("kf_interval")))
    floor = (_off(x("min_kf_samples")) & _off(y("min_kf_samples"))) | _same(x("min_kf_samples"), y("min_kf_samples"))
    return (x("mtime") == y("mtime")) & (x("mtime_nsec") == y("mtime_nsec")) & (x("size") == y("size")) & sampling & (_off(y("kf_interval")) | floor)


def lookup(files: DataFrame, cached: DataFrame, min_duration: float = 0.0) -> DataFrame:
    """Adds `status` to files(path, STAMP): hit, refused, short or miss.

    cached(path, STAMP, kind, samples, duration): kind is "media", "refused" or "short"; an entry without
    samples never hits, and a short one is decided anew by its runtime.
    """
    now = files.select("path", F.struct(*STAMP).alias("now"))
    kept = cached.select(F.col("path").alias("_p"), F.struct(*STAMP).alias("kept"), "kind", "samples", F.col("duration").alias("_d"))
    found = now.join(kept, (F.col("path") == F.col("_p")) & stamp_matches("kept", "now"), "left")
    short = (F.lit(min_duration) > 0) & (F.col("_d") > 0) & (F.col("_d") < min_duration)
    status = (
        F.when(F.col("kind") == "media", F.when(F.col("samples") > 0, F.when(short, "short").otherwise("hit")).otherwise("miss"))
        .when(F.col("kind") == "refused", "refused").when((F.col("kind") == "short") & short, "short").otherwise("miss")
    )
    return found.select("path", status.alias("status"))


def stale(cached: DataFrame, scanned: DataFrame) -> DataFrame:
    """Entries whose path was not found by the scan."""
    return cached.join(scanned.select("path").distinct(), "path", "left_anti")


def prune_obstacle(tally: dict[str, int], files: int) -> str | None:
    """Why entries must not be pruned after this scan: it may have missed files that exist."""
    for name in ("unresolved", "unwalkable", "unreadable"):
        if tally.get(name):
            return f"{tally[name]} {name}"
    return None if files else "no file was found"


class Cache:
    """A table of entries keyed by path, under `root`/VERSION."""

    def __init__(self, spark: SparkSession, root: str, version: str = VERSION):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self) -> str | None:
        fs, top = self._fs(f"{self.root}/{self.version}")
        if not fs.exists(top):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName().startswith("table-"))
        done = [n for n in names if self._fs(f"{self.root}/{self.version}/{n}/_SUCCESS")[0].exists(self._fs(f"{self.root}/{self.version}/{n}/_SUCCESS")[1])]
        return f"{self.root}/{self.version}/{done[-1]}" if done else None

    def read(self) -> DataFrame | None:
        at = self._current()
        return self.spark.read.parquet(at) if at else None

    def _replace(self, rows: DataFrame) -> None:
        old = self._current()
        n = int(old.rsplit("table-", 1)[1].split("-")[0]) + 1 if old else 0
        rows.write.parquet(f"{self.root}/{self.version}/table-{n:09d}-{uuid.uuid4().hex}")
        if old:
            fs, p = self._fs(old)
            fs.delete(p, True)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace the entries of the same paths, refusals included."""
        old = self.read()
        self._replace(rows if old is None else old.join(rows.select("path").distinct(), "path", "left_anti").unionByName(rows))

    def forget(self, paths: DataFrame) -> None:
        old = self.read()
        if old is not None:
            self._replace(old.join(paths.select("path").distinct(), "path", "left_anti"))

    def prune(self, scanned: DataFrame) -> int:
        old = self.read()
        if old is None:
            return 0
        gone = stale(old, scanned).select("path")
        n = gone.count()
        if n:
            self.forget(gone)
        return n

    def clear(self) -> None:
        fs, p = self._fs(f"{self.root}/{self.version}")
        fs.delete(p, True)

    def retire(self) -> list[str]:
        """Remove the tables of other versions."""
        fs, top = self._fs(self.root)
        if not fs.exists(top):
            return []
        gone = [s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName() != self.version]
        for name in gone:
            fs.delete(self._fs(f"{self.root}/{name}")[1], True)
        return gone
