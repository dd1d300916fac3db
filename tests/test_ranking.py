import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from twinreel import constants as K
from twinreel.functions import formatting as fmt
from twinreel.operators import decide, ranking, report
from twinreel.sources import tables as t

SCHEMA = "group_no long, media_id long, pos int, path string, codec string, duration double, width int, height int, file_size long, frame_rate double"


def _members(spark, rows):
    return ranking.with_figures(spark.createDataFrame(rows, SCHEMA))


def _one(n, path=None, codec="h264", duration=60.0, w=1920, h=1080, size=1 << 20, fps=30.0, group=1):
    return (group, n, n, path or f"/p{n}", codec, duration, w, h, size, fps)


def _best(spark, rows, priority):
    return ranking.find_best(ranking.with_tiers(_members(spark, rows), "group_no"), priority, "group_no").first()["best"]


def test_find_best(spark):
    rows = [_one(1, w=1280, h=720, duration=100.0), _one(2, duration=60.0), _one(3, duration=60.5, size=9 << 20)]
    assert _best(spark, rows, "length") == 1
    assert _best(spark, rows, "resolution") == 3
    assert _best(spark, rows, "size") == 3
    assert _best(spark, [_one(2, path="/b"), _one(1, path="/a")], "length") == 1
    with pytest.raises(ValueError, match="priority"):
        ranking.ordered_metrics("colour")


def _fold(rows, priority):
    """Reference ranking in plain Python: tiers, then values, pairwise ties where a figure is unknown, then path."""
    order = ranking.ordered_metrics(priority)
    ms = []
    for _, n, _, path, codec, dur, w, h, size, fps in sorted(rows, key=lambda r: r[3]):
        br = int(size * 8 / dur) if dur > 0 else 0
        ms.append({"n": n, "path": path, "codec": codec, "d": dur, "r": w * h, "q": int(br / fps) if fps > 0 else 0, "s": size, "fps": fps})
    top = {"d": max(m["d"] for m in ms), "r": max(m["r"] for m in ms)}
    cod = {c: {k: max(m[k] for m in ms if m["codec"] == c) for k in "qs"} for c in {m["codec"] for m in ms}}

    def tier(m, k):
        within = lambda v, x: 1 if x == 0 else int(v >= x * 0.95)
        if k == "length":
            return 1 if m["d"] <= 0 else int(m["d"] >= top["d"] - 1)
        if k == "resolution":
            return within(m["r"], top["r"])
        if k == "quality":
            return 1 if m["fps"] <= 0 or m["d"] <= 0 else within(m["q"], cod[m["codec"]]["q"])
        return within(m["s"], cod[m["codec"]]["s"])

    def ahead(a, b):
        for k in order:
            if tier(a, k) != tier(b, k):
                return tier(a, k) > tier(b, k)
        for k in order:
            if k in ("length", "quality") and min(a["d"], b["d"]) <= 0 or k == "quality" and min(a["fps"], b["fps"]) <= 0:
                continue
            x, y = {"length": (int(a["d"] * 1000), int(b["d"] * 1000)), "resolution": (a["r"], b["r"]), "quality": (a["q"] * cod[b["codec"]]["q"], b["q"] * cod[a["codec"]]["q"]), "size": (a["s"] * cod[b["codec"]]["s"], b["s"] * cod[a["codec"]]["s"])}[k]
            if x != y:
                return x > y
        return a["path"] < b["path"]

    best = ms[0]
    for m in ms[1:]:
        best = m if ahead(m, best) else best
    return best["n"]


def test_find_best_with_unknown_values(spark):
    import random

    rng = random.Random(9)
    rows = []
    for g in range(60):
        for i in range(rng.randrange(1, 6)):
            rows.append(_one(g * 10 + i, codec=rng.choice(["h264", "av1"]), duration=rng.choice([0.0, 60.0, 60.4, 75.0]), w=rng.choice([1280, 1920, 1900]), size=rng.choice([1 << 20, 1 << 21, 2_090_000]), fps=rng.choice([0.0, 25.0, 30.0]), group=g))
    for p in K.METRICS:
        got = dict(ranking.find_best(ranking.with_tiers(_members(spark, rows), "group_no"), p, "group_no").collect())
        assert got == {g: _fold([r for r in rows if r[0] == g], p) for g in range(60)}


def test_fates(spark):
    # same length and size, two codecs: the best of each is for a person to decide; the rest go
    rows = [_one(1, codec="h264", size=4 << 20), _one(2, codec="hevc", size=2 << 20), _one(3, codec="h264", size=3 << 20)]
    assert dict(decide.fates(_members(spark, rows)).collect()) == {1: "REVIEW", 2: "REVIEW", 3: "DELETE"}
    # unknown runtime: it, and the best of the measured, are reviewed
    rows = [_one(1, duration=0.0), _one(2, size=3 << 20), _one(3)]
    assert dict(decide.fates(_members(spark, rows)).collect()) == {1: "REVIEW", 2: "REVIEW", 3: "DELETE"}
    # the pick is shorter than another: that one is reviewed
    rows = [_one(1, duration=100.0, w=640, h=360), _one(2, duration=60.0)]
    assert dict(decide.fates(_members(spark, rows), "resolution").collect()) == {1: "REVIEW", 2: "KEEP"}
    # a file doomed in one group and kept in another goes; reviewed anywhere, it stays for review
    rows = [_one(1, size=9 << 20), _one(2), _one(2, group=2), _one(3, group=2, size=1000)]
    assert dict(decide.fates(_members(spark, rows)).collect()) == {1: "KEEP", 2: "DELETE", 3: "DELETE"}
    r = decide.reclaimable(_members(spark, rows), decide.fates(_members(spark, rows))).first()
    assert (r["groups"], r["files"], r["delete_count"], r["reclaimable_bytes"]) == (2, 3, 2, (1 << 20) + 1000)


def test_formats(spark):
    cases = {
        "size": (fmt.size, {0: "0B", 1023: "1023B", 1024: "1.0KB", 1280: "1.2KB", 1792: "1.8KB", 1 << 20: "1.0MB", 3 << 30: "3.0GB"}),
        "bitrate": (fmt.bitrate, {0: "0bps", 999: "999bps", 139810: "140kbps", 2500: "2kbps", 1_250_000: "1.2Mbps"}),
        "quality": (fmt.quality, {0: "-", 999: "999b/f", 4660: "4.7kb/f", 2_000_000: "2.0Mb/f"}),
    }
    for f, want in cases.values():
        df = spark.createDataFrame([(k,) for k in want], "x long")
        assert {r[0]: r[1] for r in df.select("x", f(F.col("x"))).collect()} == want
    floats = {
        fmt.duration: {0.0: "00:00:00", 59.5: "00:01:00", 3661.2: "01:01:01", 360000.0: "100:00:00"},
        fmt.shared: {None: "-", 0.0: "0s", 0.05: "<0.1s", 9.94: "9.9s", 10.0: "10s", 59.6: "1m00s", 119.7: "2m00s", 3599.7: "1h00m", 5400.0: "1h30m"},
        fmt.frame_rate: {0.0: "-", float("nan"): "-", 29.995: "30fps", 23.976: "23.98fps"},
    }
    for f, want in floats.items():
        df = spark.createDataFrame([(k, v) for k, v in want.items()], "x double, want string")
        assert [r for r in df.select("x", "want", f(F.col("x")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_report_round_trip(spark, tmp_path):
    from twinreel.sources import reports

    rows = [_one(1, path="/fake/path/vid.mp4"), _one(2, path='/fake/a "b"; c.mp4', size=1000)]
    m = _members(spark, rows)
    fates = decide.fates(m)
    links = spark.createDataFrame([(1, 2, 0.5, (1000, 31000)), (2, 1, 1.0, (0, 60000))], "subject long, other long, coverage float, span struct<start_ms long, end_ms long>")
    media = m.drop("group_no", "pos")
    samples = spark.createDataFrame([(1,), (1,), (2,)], "media_id long")
    linked = report.group_links(m.select("group_no", "media_id"), links, media)
    detail = report.described(m, linked, fates, samples).cache()
    out, groups, found = report.text_rows(detail), report.json_groups(detail, linked), report.summary(decide.reclaimable(m, fates).first())
    text = "".join(report.csv_text(out))
    head, first, *_ = csv.reader(io.StringIO(text), delimiter=";")
    assert tuple(head) == K.REPORT_COLUMNS
    assert first == "group_1;KEEP;/fake/path/vid.mp4;00:01:00;60.00;1920x1080;1920;1080;30;h264;1.0MB;1048576;140kbps;139810;4.7kb/f;4660;".split(";")[:-1] + ['/fake/a "b"; c.mp4', "2", "30.00", "00:00:01", "00:00:31", "1.00", "31.00"]
    for kind in ("csv", "json"):
        path = str(tmp_path / f"r.{kind}")
        report.write_report(out, path, None, groups, found)
        got = reports.verdicts(reports.read_report(spark, path)).where("verdict = 'delete'").collect()
        assert [(r["full_path"], int(r["bytes"])) for r in got] == [('/fake/a "b"; c.mp4', 1000)]
    got = json.load(open(tmp_path / "r.json"))
    assert list(got) == ["summary", "results"]
    assert got["summary"] == found and len(found) == 14 and found["files_marked_delete"] == 1 and found["mode"] == "report"
    (group,) = got["results"]
    assert group["group"] == "group_1" and [f["size_bytes"] for f in group["files"]] == [1 << 20, 1000]
    assert group["files"][0]["matches"] == [{"full_path": '/fake/a "b"; c.mp4', "matched_seconds": 30.0, "matched_from": "00:00:01", "matched_to": "00:00:31", "matched_from_seconds": 1.0, "matched_to_seconds": 31.0}]
    assert list(group["files"][0]) == [*K.REPORT_COLUMNS[1:], "matches"]
    none = "".join(report.json_text(groups.where("false"), found))
    assert json.loads(none) == {"summary": found, "results": []}
    report.write_report(out, str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text().startswith("group_1:\n  KEEP     /fake/path/vid.mp4")
    assert report.format_for("x.CSV") == "csv"
    assert report.format_for(None) == "txt"


def test_replay_verdicts(spark):
    from twinreel.sources import reports

    cells = [
        (" Delete ", "/a/b", " 7 ", "delete", None), ("delete", "/a/b", "8", "repeat", None), ("KEEP", "/c", "x", "ignore", None), ("", "/c", "x", "ignore", None),
        ("destroy", "/c", "1", "unusable", "action"), ("delete", "  ", "1", "unusable", "no full_path"), ("delete", "c", "1", "unusable", "is not an absolute path"),
        ("delete", "/a/../c", "1", "unusable", 'contains a ".." component'), ("delete", "/d", "-1", "unusable", "unusable size_bytes"), ("delete", "/d", "18446744073709551616", "unusable", "unusable size_bytes"),
        ("delete", "/e ", "18446744073709551615", "delete", None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cells)], "row_no long, action string, full_path string, size_bytes string")
    got = [(r["verdict"], r["reason"]) for r in reports.verdicts(df).orderBy("row_no").collect()]
    assert got == [c[3:] for c in cells]


def test_links_by_classes_are_the_links(spark):
    d = "/root/testdata/sf0.001"
    media = t.part_media(spark, d, True)  # some runtimes unknown
    groups = media.select((F.col("media_id") % 3).alias("group_no"), "media_id").unionByName(media.where("media_id < 40").select(F.lit(9).cast("long").alias("group_no"), "media_id"))
    pairs = groups.alias("x").join(groups.alias("y"), "group_no").where("x.media_id <> y.media_id").select(F.col("x.media_id").alias("subject"), F.col("y.media_id").alias("other")).distinct()
    classes, between = t.part_classes(spark, d)
    named = pairs.join(classes.select(F.col("media_id").alias("subject"), F.col("link_class").alias("subject_class")), "subject").join(classes.select(F.col("media_id").alias("other"), F.col("link_class").alias("other_class")), "other")
    links = named.join(between, ["subject_class", "other_class"])
    want = report.group_links(groups, links.select("subject", "other", "coverage", "span"), media)
    rows = lambda df: sorted(tuple(r) for r in df.select("group_no", "subject", "other", "other_path", F.round("matched_seconds", 9), "span.start_ms", "span.end_ms", "rank").collect())
    made, expected = report.class_links(groups, classes, between, media), rows(want)
    assert rows(made) == expected and len(expected) > 10_000
    assert rows(report.class_links(groups, classes, between, media, 1)) == [r for r in expected if r[-1] == 1]
    # links are made, not exchanged and ordered: nothing stands above the join that makes them
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Window" not in above and "Aggregate" not in above and "Sort" not in above


def test_json_by_classes_is_a_row_a_file_and_exchanges_no_link(spark):
    d = "/root/testdata/sf0.001"
    media = t.part_media(spark, d, True)
    groups = media.select((F.col("media_id") % 3).alias("group_no"), "media_id")
    members = groups.withColumn("pos", (F.col("media_id") / 3).cast("int")).join(ranking.with_figures(media), "media_id").cache()
    classes, between = t.part_classes(spark, d)
    linked = report.class_links(groups, classes, between, media)
    samples = spark.createDataFrame([(1,), (1,), (2,)], "media_id long")
    detail = report.described(members, linked, decide.fates(members), samples).cache()
    made = report.class_json_groups(detail, groups, classes, between, media)
    key = lambda df: sorted(map(tuple, df.select("group_no", "group", "pos", "json").collect()))
    got = key(made)
    assert got == key(report.json_groups(detail, linked)) and len(got) == groups.count()
    whole = json.loads("".join(report.json_text(made, {})))["results"]
    assert [g["group"] for g in whole] == ["group_0", "group_1", "group_2"] and [f for g in whole for f in g["files"]] == [json.loads(r[3]) for r in got]
    text = "".join(report.json_text(made, {"n": 1}))
    assert text == json.dumps({"summary": {"n": 1}, "results": whole}, indent=2, ensure_ascii=False) + "\n"
    # the join that gives a file its links is the last one, and nothing is exchanged or sorted above it
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Sort" not in above and "Repartition" not in above
    # media and their classes are not sent to all tasks, small as they are here
    assert report._by_class(groups, classes, between, media)[0]._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0


def test_links_are_made_by_stretches_that_repeat_where_written(spark, tmp_path, monkeypatch):
    d = "/root/testdata/sf0.001"
    media = t.part_media(spark, d, True)
    groups = media.select((F.col("media_id") % 3).alias("group_no"), "media_id")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(report.class_links(groups, *t.part_classes(spark, d), media))
    monkeypatch.setattr(report, "STRETCH", 16)
    monkeypatch.setattr(report, "TASK_LINKS", 300)
    assert report._tasks(groups)[2] > 1 and rows(report.class_links(groups, *t.part_classes(spark, d), media)) == whole
    monkeypatch.undo()
    # one large group: its links differ in subject, other and rank, and yet take less than a byte each
    n = F.col("id")
    large = spark.range(2000).select(n.alias("media_id"), F.concat(F.lit("/brand/"), n.cast("string")).alias("path"), (60 + n % 7 * 0.4).alias("duration"))
    classes = large.select("media_id", F.lit(5).cast("long").alias("link_class"))
    links = report.class_links(large.select(F.lit(1).cast("long").alias("group_no"), "media_id"), classes, t.part_classes(spark, d)[1], large)
    links.drop("span").coalesce(1).write.parquet(f"{tmp_path}/links")
    assert spark.read.parquet(f"{tmp_path}/links").count() == 2000 * 1999
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < 2000 * 1999


@pytest.mark.parametrize("among", ["all", "others"])
def test_links_read_from_json_are_those_of_the_files(spark, monkeypatch, among):
    d = "/root/testdata/sf0.001"
    media = t.part_media(spark, d, True)
    groups = media.select((F.col("media_id") % 3).alias("group_no"), "media_id").unionByName(media.where("media_id = 5").select(F.lit(9).cast("long").alias("group_no"), "media_id"))
    members = groups.withColumn("pos", (F.col("media_id") / 3).cast("int")).join(ranking.with_figures(media), "media_id").cache()
    classes, between = t.part_classes(spark, d)
    between = between if among == "all" else between.where("subject_class <> other_class")
    samples = spark.createDataFrame([(1,), (1,), (2,)], "media_id long")
    detail = report.described(members, report.class_links(groups, classes, between, media), decide.fates(members), samples).cache()
    link = "full_path string, matched_seconds double, matched_from string, matched_to string, matched_from_seconds double, matched_to_seconds double"
    file = f"action string, samples long, {link}, matches array<struct<{link.replace(' ', ':').replace(',:', ',')}>>"
    read = report.class_json_groups(detail, groups, classes, between, media).select("group", "pos", F.from_json("json", file).alias("f"))
    cells = lambda f: [F.col(f"{f}.{c}") for c in ("full_path", "matched_from", "matched_to", "matched_from_seconds", "matched_to_seconds")]
    want = read.select("group", "pos", "f", F.posexplode_outer("f.matches").alias("n", "l")).select("group", "pos", F.col("f").dropFields("matches"), "n", *cells("l"), "l.matched_seconds")
    monkeypatch.setattr(report, "TASK_LINKS", 300)
    made = report.class_json_links(detail, groups, classes, between, media, file, link)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    got = rows(made.select("group", "pos", F.col("f").dropFields("matches"), "n", *cells("l"), "link_seconds"))
    assert got == rows(want) and len(got) > 10_000 and made.where("n IS NULL").count() == 1
    # no link is written or read once for each file
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan[: plan.index("Join")].replace("link_seconds", "") and "Generate" not in plan[: plan.index("Join")]
