import csv

import numpy as np

from twinreel.cli import main


def _clip(path, frames):
    h, w = frames[0].shape
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F2:1 Cmono\n".encode() + b"".join(b"FRAME\n" + f.tobytes() for f in frames))


def test_scan_report_and_replay(spark, tmp_path):
    rng = np.random.default_rng(4)
    one, two = ([rng.integers(0, 255, (64, 64), dtype=np.uint8) for _ in range(8)] for _ in range(2))
    folder = tmp_path / "in"
    folder.mkdir()
    _clip(folder / "a.y4m", one)
    _clip(folder / "b.y4m", one)
    _clip(folder / "c.y4m", two)
    out = tmp_path / "r.csv"
    assert main([str(folder), "-o", str(out)], spark) == 0
    rows = list(csv.DictReader(out.open(), delimiter=";"))
    assert [(r["action"], r["full_path"].rsplit("/", 1)[1]) for r in rows] == [("KEEP", "a.y4m"), ("DELETE", "b.y4m")]
    assert main(["--from-report", str(out), "--move-to", str(tmp_path / "gone"), "-y"], spark) == 0
    assert not (folder / "b.y4m").exists()
    assert (folder / "a.y4m").exists()
    assert main([str(folder), "-d", "99"], spark) == 1
    assert main([str(tmp_path / "none"), "-q"], spark) == 2


def test_a_second_scan_decodes_nothing(spark, tmp_path, monkeypatch, capsys):
    import twinreel.cli as cli

    rng = np.random.default_rng(5)
    frames = [rng.integers(0, 255, (64, 64), dtype=np.uint8) for _ in range(8)]
    folder, cache = tmp_path / "in", f"file://{tmp_path}/cache"
    folder.mkdir()
    _clip(folder / "a.y4m", frames)
    _clip(folder / "b.y4m", frames)
    (folder / "bad.pgm").write_bytes(b"P5 9 9 255 ")
    one, two = tmp_path / "1.csv", tmp_path / "2.csv"
    assert main([str(folder), "--cache", cache, "-o", str(one)], spark) == 2
    opened = []
    real = cli.entries
    monkeypatch.setattr(cli, "entries", lambda files, *a: (opened.extend(r["path"] for r in files.select("path").collect()), real(files, *a))[1])
    assert main([str(folder), "--cache", cache, "-o", str(two)], spark) == 2
    assert not opened
    assert one.read_text() == two.read_text()
    _clip(folder / "c.y4m", frames)
    (folder / "a.y4m").unlink()
    assert main([str(folder), "--cache", cache, "--prune-cache", "-o", str(two)], spark) == 2
    assert [p.rsplit("/", 1)[1] for p in opened] == ["c.y4m"]
    assert {r["path"].rsplit("/", 1)[1] for r in cli.Cache(spark, cache).read().collect()} == {"b.y4m", "bad.pgm", "c.y4m"}


def test_an_output_that_cannot_be_written_is_said_before_the_work(spark, tmp_path, monkeypatch):
    import twinreel.cli as cli

    monkeypatch.setattr(cli, "scan", lambda *a: 1 / 0)
    assert main([str(tmp_path), "-o", str(tmp_path)], spark) == 1
    assert main([str(tmp_path), "-o", str(tmp_path / "no" / "r.csv")], spark) == 1


def test_moves_leave_no_parts_and_trash_can_be_restored(tmp_path, monkeypatch):
    import errno
    import os

    from twinreel.operators import dispose

    def other_device(*a, **k):
        raise OSError(errno.EXDEV, "other device")

    monkeypatch.setattr(os, "link", other_device)
    a, link = tmp_path / "a", tmp_path / "l"
    a.write_text("content")
    link.symlink_to("a")
    assert dispose.dispose_one(str(link), 7, dispose.Disposal("move", str(tmp_path / "to")))[0] == "UNLINKED"
    assert os.readlink(dispose.target_under(str(tmp_path / "to"), str(link))) == "a"
    with monkeypatch.context() as m:
        m.setattr(dispose.shutil, "copyfileobj", lambda src, dst, n: (dst.write(b"par"), other_device()))
        assert dispose.dispose_one(str(a), 7, dispose.Disposal("move", str(tmp_path / "to")))[0] == "FAILED"
    assert a.exists()
    assert not os.path.lexists(dispose.target_under(str(tmp_path / "to"), str(a)))
    trash = tmp_path / "trash"
    for _ in range(2):
        a.write_text("content")
        assert dispose.dispose_one(str(a), 7, dispose.Disposal("trash", str(trash)))[0] == "DELETED"
    assert sorted(p.name for p in (trash / "files").iterdir()) == ["a", "a.1"]
    assert f"Path={a}" in (trash / "info" / "a.1.trashinfo").read_text()
