"""Which files are meant: walking folders, path lists, and the predicates on paths."""

from __future__ import annotations

import os
import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinreel.constants import EXTENSIONS, PROBE_BYTES, PROBE_BYTES_MORE


def normalize_extensions(given: str | Sequence[str] | None = None) -> list[str] | None:
    """Lower-cased extensions without "*." or dots; None for "*" (everything)."""
    parts = EXTENSIONS if given is None else given.split(",") if isinstance(given, str) else given
    out = []
    for p in parts:
        p = p.strip()
        if p == "*":
            return None
        p = p.removeprefix("*").strip(".").lower()
        if p and p not in out:
            out.append(p)
    if not out:
        raise ValueError("no file extension given")
    return out


def extension(path: Column) -> Column:
    """Lower-cased extension of a path's last part; none for names that only start with a dot."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def accepted(path: Column, extensions: Sequence[str] | None, named: Column | None = None) -> Column:
    """Is the extension wanted?  Files named in the request always are."""
    ok = F.lit(True) if extensions is None else extension(path).isin(list(extensions))
    return ok if named is None else ok | named


def drop_excluded(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files that are not, and are not below, any path of excludes(path); whole components count.

    A file is looked up by each of its own ancestors, so the join is an equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    bad = files.select("path", F.explode(ancestors).alias("_up")).join(excludes.select(F.regexp_replace("path", "/+$", "").alias("_up")).distinct(), "_up").select("path").distinct()
    return files.join(bad, "path", "left_anti")


def drop_aliases(files: DataFrame) -> DataFrame:
    """One path for each (dev, ino): the first in request order."""
    w = Window.partitionBy("dev", "ino").orderBy("request_pos", "path")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def walk_reaches(roots: Iterable[str], destination: str, excludes: Iterable[str] = ()) -> bool:
    """Would a walk of the roots come across the destination?"""
    inside = lambda p, top: p == top or p.startswith(top.rstrip("/") + "/")
    return any(inside(destination, r) for r in roots) and not any(inside(destination, e) for e in excludes)


def probe_score(content: Column) -> Column:
    """2: surely media, 1: looks like text that might be a playlist or script, 0: nothing known; of the first bytes given."""
    head = F.hex(F.substring(content, 1, 16))
    sure = [F.startswith(head, F.lit(x)) for x in ("1A45DFA3", "52494646", "464C5601", "000001BA", "000001B3", "3026B275", "4F676753", "5955563450", "5035")]
    mp4 = F.substring(head, 9, 8) == "66747970"
    ts = (F.substring(head, 1, 2) == "47") & (F.hex(F.substring(content, 189, 1)) == "47")
    found = mp4 | ts
    for s in sure:
        found = found | s
    return F.when(found, 2).when(F.startswith(head, F.lit("23")) | F.startswith(head, F.lit("3C")), 1).otherwise(0)


def probe(files: DataFrame) -> DataFrame:
    """Adds `media` and `probed`: whether the first bytes pass the gate, and how many were looked at."""
    first, more = probe_score(F.substring("content", 1, PROBE_BYTES)), probe_score(F.substring("content", 1, PROBE_BYTES_MORE))
    scored = files.withColumn("_a", first).withColumn("_b", F.when(F.col("_a") == 1, more))
    return scored.withColumn("media", F.when(F.col("_a") == 1, F.col("_b") > 1).otherwise(F.col("_a") > 1)).withColumn("probed", F.least(F.length("content"), F.when(F.col("_a") == 1, F.lit(PROBE_BYTES_MORE)).otherwise(PROBE_BYTES))).drop("_a", "_b")


def split_path_list(data: bytes, null: bool = False) -> tuple[list[str], int]:
    """(paths, undecodable): entries end at newlines (one carriage return before it is dropped) or, with `null`, at NUL."""
    paths, bad = [], 0
    for raw in data.split(b"\0" if null else b"\n"):
        raw = raw if null else raw.removesuffix(b"\r")
        if not raw.strip():
            continue
        try:
            paths.append(raw.decode())
        except UnicodeDecodeError:
            bad += 1
    return paths, bad


def path_list(spark: SparkSession, file: str, null: bool = False) -> DataFrame:
    """(path, request_pos-free) rows of a list file, by Spark's text reader; entries that are not UTF-8 are null in `path`."""
    reader = spark.read.option("lineSep", "\0" if null else "\n").text(file)
    value = F.col("value") if null else F.regexp_replace("value", "\r$", "")
    return reader.select(F.when(F.is_valid_utf8("value"), value).alias("path")).where(F.col("path").isNull() | (F.trim("path") != ""))


def requested_paths(args: Sequence[str], from_file: str | None = None, null: bool = False) -> Iterator[str]:
    """Arguments, with "-" for standard input (read once), then the entries of a list file."""
    used = False
    for a in args:
        if a != "-":
            yield a
        elif not used:
            used = True
            yield from split_path_list(sys.stdin.buffer.read(), null)[0]
    if from_file:
        with open(from_file, "rb") as f:
            yield from split_path_list(f.read(), null)[0]


@dataclass
class Library:
    files: list[tuple] = field(default_factory=list)  # path, size, mtime, mtime_nsec, dev, ino, named
    roots: list[str] = field(default_factory=list)
    problems: Counter = field(default_factory=Counter)


def collect(paths: Iterable[str], recursive: bool = False, extensions: Sequence[str] | None = EXTENSIONS, excludes: Iterable[str] = (), follow_links: bool = False) -> Library:
    """Files of a request: folders are walked (one level, or all), links into folders only if asked, aliases once."""
    out, seen, folders = Library(), set(), set()
    barred = []
    for e in excludes:
        if os.path.lexists(e):
            barred.append(os.path.realpath(e))
        else:
            out.problems["exclude_unresolved"] += 1
    inside = lambda p: any(p == b or p.startswith(b + "/") for b in barred)

    def take(path: str, named: bool) -> None:
        try:
            path.encode()
        except UnicodeEncodeError:
            out.problems["undecodable"] += 1
            return
        if not named and extensions is not None and os.path.splitext(path)[1].lstrip(".").lower() not in extensions or inside(os.path.realpath(path)):
            return
        try:
            s = os.stat(path)
        except OSError:
            out.problems["unreadable"] += 1
            return
        if (s.st_dev, s.st_ino) not in seen:
            seen.add((s.st_dev, s.st_ino))
            out.files.append((os.path.realpath(path), s.st_size, int(s.st_mtime), s.st_mtime_ns % 10**9, s.st_dev, s.st_ino, named))

    def walk(top: str) -> None:
        todo = [top]
        while todo:
            folder = todo.pop()
            try:
                s = os.stat(folder)
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                out.problems["unwalkable"] += 1
                continue
            if (s.st_dev, s.st_ino) in folders or inside(os.path.realpath(folder)):
                continue
            folders.add((s.st_dev, s.st_ino))
            below = []
            for e in entries:
                if e.is_dir(follow_symlinks=follow_links):
                    below.append(e.path)
                elif e.is_file():
                    take(e.path, False)
            if recursive:
                todo += reversed(below)

    for p in paths:
        if not os.path.exists(p):
            out.problems["unresolved"] += 1
        elif inside(real := os.path.realpath(p)):
            continue
        elif os.path.isdir(real):
            out.roots.append(real)
            walk(real)
        else:
            take(real, True)
    return out


FILES = "path string, size long, mtime long, mtime_nsec long, dev long, ino long, named boolean"


def files_frame(spark: SparkSession, library: Library) -> DataFrame:
    return spark.createDataFrame([(*f[:4], f[4] % 2**63, f[5] % 2**63, f[6]) for f in library.files], FILES)
