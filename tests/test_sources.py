import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinreel.operators import cache, dispose, samples, stats
from twinreel.sources import decoders, files


def test_extensions(spark):
    assert files.normalize_extensions("*.MP4, .mkv,mkv") == ["mp4", "mkv"]
    assert files.normalize_extensions("*") is None
    assert len(files.normalize_extensions()) == 18
    with pytest.raises(ValueError, match="extension"):
        files.normalize_extensions(" , .")
    df = spark.createDataFrame([("/a/x.MP4", ""), ("/a/.mp4", ""), ("/a.b/c", ""), ("/a/x.tar.gz", "")], "path string, x string")
    assert [r[0] for r in df.select(files.extension(F.col("path"))).collect()] == ["mp4", "", "", "gz"]


def test_excludes_take_whole_components(spark):
    f = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",), ("/d",)], "path string")
    e = spark.createDataFrame([("/a/b/",)], "path string")
    assert {r[0] for r in files.drop_excluded(f, e).collect()} == {"/a/bc", "/d"}
    assert files.walk_reaches(["/a"], "/a/b")
    assert not files.walk_reaches(["/a"], "/ab")
    assert not files.walk_reaches(["/a"], "/a/b", ["/a/b"])


def test_path_lists(spark, tmp_path):
    data = b"/a b\r\n\n  \n/c\n\xff\n"
    assert files.split_path_list(data) == (["/a b", "/c"], 1)
    assert files.split_path_list(b"/a\n\0/b\0", null=True) == (["/a\n", "/b"], 0)
    (tmp_path / "l").write_bytes(b"/a b\r\n\n/c\n")
    assert [r[0] for r in files.path_list(spark, str(tmp_path / "l")).collect()] == ["/a b", "/c"]


def test_collect(tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    for n in ("a.mp4", "b.txt", "d/c.mkv", "d/e/f.mp4"):
        (tmp_path / n).write_bytes(b"x")
    os.link(tmp_path / "a.mp4", tmp_path / "z.mp4")
    os.symlink(tmp_path / "d", tmp_path / "link")
    names = lambda lib: [os.path.relpath(f[0], tmp_path) for f in lib.files]
    top = str(tmp_path)
    assert names(files.collect([top])) == ["a.mp4"]
    assert names(files.collect([top], recursive=True)) == ["a.mp4", "d/c.mkv", "d/e/f.mp4"]
    assert names(files.collect([top], recursive=True, excludes=[f"{top}/d/e", f"{top}/none"])) == ["a.mp4", "d/c.mkv"]
    assert names(files.collect([f"{top}/b.txt", f"{top}/gone"])) == ["b.txt"]
    assert files.collect([f"{top}/gone"]).problems == {"unresolved": 1}


def test_aliases(spark):
    f = spark.createDataFrame([("/b", 1, 5, 0), ("/a", 1, 5, 1), ("/c", 1, 6, 2)], "path string, dev long, ino long, request_pos long")
    assert {r["path"] for r in files.drop_aliases(f).collect()} == {"/b", "/c"}


def test_clock_and_subsampling(spark):
    rows = [(1, i, t) for i, t in enumerate([10, 30, 30, 5, 15, 0])]
    df = spark.createDataFrame(rows, "media_id long, seq long, ts long")
    got = samples.sample_clock(df).orderBy("seq").collect()
    assert [r["elapsed"] for r in got] == [0, 20, 20, 40, 50, 60]
    assert [r["restarted"] for r in got] == [False, False, False, True, False, True]
    kept = samples.subsample(samples.sample_clock(df), F.lit(25)).orderBy("seq").collect()
    assert [r["elapsed"] for r in kept] == [0, 40]
    assert samples.subsample(samples.sample_clock(df), F.lit(0)).count() == 6


def test_spans_end_at_the_next_change_of_any_kind(spark):
    rows = [(1, 0, 7, True, 0, 900), (1, 1, 7, True, 100, 900), (1, 2, 0, False, 200, 900), (1, 3, 8, True, 300, 900)]
    df = spark.createDataFrame(rows, "media_id long, seq long, hash long, valid boolean, t_start long, total_ms long")
    got = samples.spans(samples.collapse(df)).orderBy("idx").collect()
    assert [(r["idx"], r["hash"], r["t_start"], r["t_end"]) for r in got] == [(0, 7, 0, 200), (1, 8, 300, 900)]


def test_sample_times(spark):
    def run(times, duration):
        df = spark.createDataFrame([(1, i, t, duration) for i, t in enumerate(times)], "media_id long, seq long, t long, duration double")
        got = samples.sample_times(df).orderBy("seq").collect()
        return [r["t_start"] for r in got], got[0]["total_ms"]

    assert run([0, 400, 900], 2.0) == ([0, 400, 900], 2000)
    assert run([0, 400, 1000], 0.5) == ([0, 400, 1000], 1500)
    assert run([0, None, 900], 3.0) == ([0, 1000, 2000], 3000)
    assert run([None, None], 0.0) == ([0, 1], 2)
    assert run([0], 0.0) == ([0], 1)


def _y4m(frames, fps=10):
    h, w = frames[0].shape
    return f"YUV4MPEG2 W{w} H{h} F{fps}:1 Cmono\n".encode() + b"".join(b"FRAME\n" + f.tobytes() for f in frames)


def test_decoding(spark, tmp_path):
    rng = np.random.default_rng(2)
    clip = [rng.integers(0, 255, (72, 96), dtype=np.uint8) for _ in range(5)]
    clip.insert(2, clip[1])
    (tmp_path / "a.y4m").write_bytes(_y4m(clip))
    (tmp_path / "b.pgm").write_bytes(b"P5\n# note\n96 72 255\n" + clip[0].tobytes())
    (tmp_path / "flat.pgm").write_bytes(b"P5 8 8 255\n" + bytes(64))
    (tmp_path / "c.txt").write_bytes(b"hello")
    rows = decoders.fingerprint(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r["path"]), []).append(r)
    assert [r["t"] for r in sorted(by["a.y4m"], key=lambda r: r["seq"])] == [0, 100, 300, 400, 500]
    assert by["b.pgm"][0]["width"] == 96
    assert by["flat.pgm"][0]["problem"] == "all 1 sampled frames were featureless"
    assert by["c.txt"][0]["problem"].startswith("not media")


def test_crop_and_area():
    from twinreel.functions import pixels

    frames = np.zeros((4, 64, 64), np.uint8)
    frames[:, 20:50, :] = np.random.default_rng(3).integers(0, 255, (4, 30, 64))
    assert pixels.moving_area(frames) == (21, 28, 0, 64)
    assert pixels.moving_area(frames[:1]) == (0, 64, 0, 64)
    assert np.allclose(pixels._area(3, 40, 16, 64).sum(1), 1)


def test_cache(spark, tmp_path):
    c = cache.Cache(spark, f"file://{tmp_path}/cache")
    row = lambda p, n: (p, 1, 2, n, 0.0, 12.0, "media", 5, 9.0)
    schema = "path string, mtime long, mtime_nsec long, size long, kf_interval double, min_kf_samples double, kind string, samples long, duration double"
    assert c.read() is None
    c.upsert(spark.createDataFrame([row("/a", 1), row("/b", 2)], schema))
    c.upsert(spark.createDataFrame([row("/a", 3)], schema))
    assert {(r["path"], r["size"]) for r in c.read().collect()} == {("/a", 3), ("/b", 2)}
    now = spark.createDataFrame([("/a", 1, 2, 3, -1.0, 99.0), ("/b", 1, 2, 2, 5.0, 12.0), ("/c", 1, 2, 2, 0.0, 0.0)], "path string, mtime long, mtime_nsec long, size long, kf_interval double, min_kf_samples double")
    assert dict(cache.lookup(now, c.read()).collect()) == {"/a": "hit", "/b": "miss", "/c": "miss"}
    assert dict(cache.lookup(now, c.read(), 10.0).collect())["/a"] == "short"
    assert c.prune(now.where("path = '/a'")) == 1
    assert [r["path"] for r in c.read().collect()] == ["/a"]
    assert cache.Cache(spark, f"file://{tmp_path}/cache", "v2").retire() == ["v1"]
    assert cache.prune_obstacle({"unwalkable": 2}, 5) == "2 unwalkable"
    assert cache.prune_obstacle({}, 0) == "no file was found"
    assert cache.prune_obstacle({}, 5) is None


def test_stream_into_cache(spark, tmp_path):
    from twinreel.streaming.ingest import watch

    clip = [np.random.default_rng(i).integers(0, 255, (64, 64), dtype=np.uint8) for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.y4m").write_bytes(_y4m(clip))
    (tmp_path / "in/b.y4m").write_bytes(b"no")
    c = cache.Cache(spark, f"file://{tmp_path}/cache")
    watch(spark, str(tmp_path / "in"), c, str(tmp_path / "cp"), "*.y4m", once=True).awaitTermination()
    assert {(os.path.basename(r["path"]), r["kind"], r["samples"]) for r in c.read().collect()} == {("a.y4m", "media", 3), ("b.y4m", "refused", 0)}


def test_tally_and_weights(spark):
    df = spark.createDataFrame([("a", i, f"d{i}") for i in range(25)] + [("b", 0, "x")], "category string, seq long, detail string")
    got = {r["category"]: r for r in stats.tally(df).collect()}
    assert (got["a"]["count"], len(got["a"]["samples"]), got["b"]["samples"]) == (25, 20, ["x"])
    assert stats.summary_lines(stats.tally(df))[-2:] == ["b: 1", "  x"]
    assert "  ... and 5 more" in stats.summary_lines(stats.tally(df))
    assert [stats.exit_code(0), stats.exit_code(3), stats.exit_code(0, failed=True), stats.exit_code(0, interrupted=True)] == [0, 2, 1, 130]
    assert [stats.active_threads(0, 8), stats.active_threads(99, 8), stats.active_threads(99, 2)] == [8, 32, 16]


def test_disposal(tmp_path):
    a, b, s = tmp_path / "a", tmp_path / "b", tmp_path / "s"
    a.write_bytes(b"12")
    b.write_bytes(b"123")
    os.symlink(b, s)
    out, tally = dispose.dispose([(str(a), 2), (str(b), 2)], dispose.disposal_for(True, False, str(tmp_path / "to")))
    assert [o for _, o in out] == ["MOVED", "CHANGED"]
    assert tally["MOVED bytes"] == 2
    assert (tmp_path / "to" / str(a).lstrip("/")).read_bytes() == b"12"
    a.write_bytes(b"12")
    assert dispose.dispose_one(str(a), 2, dispose.Disposal("move", str(tmp_path / "to")))[0] == "FAILED"
    assert dispose.dispose_one(str(s), 3, dispose.Disposal("permanent"))[0] == "UNLINKED"
    assert dispose.dispose_one(str(a), 2, dispose.Disposal("permanent"))[0] == "DELETED"
    assert b.exists()
    assert [dispose.interpret(x) for x in ("", " Y ", "no", "maybe")] == [True, True, False, None]
    assert not dispose.approve([("/x", 1)], dispose.Disposal("permanent"), ask=lambda _: "hm")
    assert dispose.approve([("/x", 1)], dispose.Disposal("permanent"), ask=lambda _: "")
    assert not dispose.approve([("/x", 1)], dispose.Disposal("permanent"), interactive=False)
