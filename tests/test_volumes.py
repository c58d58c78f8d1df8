import os
import time

import pytest

from reelmill.operators import report, volumes
from reelmill.settings import Settings
from reelmill.sources import library


def test_volumes_are_asked_each_by_itself(spark, tmp_path):
    assert volumes.responds(str(tmp_path)) and not volumes.responds(str(tmp_path / "gone"))
    said = volumes.asked(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()
    assert {os.path.basename(r.volume): r.answers for r in said} == {tmp_path.name: True, "gone": False}
    rows = spark.createDataFrame([("/v/a",), ("/v",), ("/vv/a",), ("/v/w/x",), ("/q",)], "path string")
    assert [r.v for r in rows.select(volumes.volume_of(rows.path, ["/v", "/v/w"]).alias("v")).collect()] == ["/v", "/v", "", "/v/w", ""]


def test_a_hanging_volume_is_given_up(tmp_path, monkeypatch):
    slow = tmp_path / "stat"
    slow.write_text("#!/bin/sh\nsleep 30\n")
    slow.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    began = time.monotonic()
    assert not volumes.responds("/", 0.3) and time.monotonic() - began < 5


def test_answers_hold_for_a_while_and_turns_are_told_once(spark):
    history = spark.createDataFrame([("/v", True, 1000), ("/v", False, 2000), ("/v", False, 3000), ("/v", True, 4000), ("/w", False, 3500), ("/x", True, 500)], volumes.ANSWER)
    assert [r.volume for r in volumes.answering(history, 5000).collect()] == ["/v"]
    assert [r.volume for r in volumes.answering(history, 3000, 2.6).orderBy("volume").collect()] == ["/v", "/x"]
    told = volumes.edges(history)
    assert sorted(map(tuple, told.collect())) == [(2000, "stuck", "/v"), (3500, "stuck", "/w"), (4000, "back", "/v")]
    assert [(r.path, r.since) for r in volumes.stuck_now(told).collect()] == [("/w", 3500)]


def test_jobs_wait_for_their_volumes(spark, tmp_path):
    """Two volumes; one answers from the third round on. Each job runs once, when both its sides answer."""
    asks = tmp_path / "asks"
    asks.write_text("")
    jobs = spark.createDataFrame([("/v/a", "/v/b"), ("/w/a", "/v/c"), ("/v/d", "/w/d"), ("/else", "/v/e")], "path string, out_path string")

    def ask(volume):
        if volume == "/w":
            with open(asks, "a") as f:
                f.write("x")
            return os.path.getsize(asks) > 2
        return True

    rounds = list(volumes.in_rounds(jobs, lambda df: df.select("path"), ["/v", "/w"], ask, every=0.0))
    assert [sorted(r.path for r in done.collect()) for done, _ in rounds] == [["/else", "/v/a"], [], ["/v/d", "/w/a"]]
    assert [(r.event, r.path) for r in volumes.edges(rounds[-1][1]).orderBy("at").collect()] == [("stuck", "/w"), ("back", "/w")]
    stop = tmp_path / "stop"
    stop.touch()
    assert list(volumes.in_rounds(jobs, lambda df: df, ["/v"], ask, volumes.marker(str(stop)))) == []


def test_large_folders_are_split(tmp_path):
    for i in range(40):
        (tmp_path / "only" / "one" / f"{i}").mkdir(parents=True)
        (tmp_path / "only" / "one" / f"{i}" / "x.mkv").write_bytes(b"x")
    (tmp_path / "only" / "y.mkv").write_bytes(b"y")
    reader = library.FolderReader(str(tmp_path), frozenset())
    parts = reader.partitions()
    found = sorted(row[0] for p in parts for row in reader.read(p))
    assert len(parts) > 30 and len(found) == len(set(found)) == 41


RESULTS = "path string, outcome string, src_bytes long, out_bytes long, notes array<struct<level string, message string>>"


def test_console_and_header(spark):
    results = spark.createDataFrame([("/a/x.mkv", "shrink", 1000, 300, [("NOTE", "done")]), ("/a/y.mkv", "skip-modern", 10, 0, []), ("/a/z.mkv", "remux", 0, 0, [])], RESULTS)
    lines = [r.line for r in report.console(results).orderBy("path", "nth").collect()]
    assert lines == ["x.mkv: shrink, 70% smaller", "  note: done", "y.mkv: already modern", "z.mkv: remux"]
    said = report.header(Settings(ignore_under=5_000_000, tier_bpp={"EXCELLENT": 0.2}), dry=True)
    assert said["H.264 at 1080p30"] == "12.4 Mbps" and said["H.265 at 1080p30"] == "7.5 Mbps" and said["bits a pixel"] == "0.2000" and said["left out under"] == "5 MB"
    assert "resume" not in said and "resume" in report.header(Settings()) and "bits a pixel" not in report.header(Settings())


@pytest.mark.parametrize(
    ("row", "said"),
    [
        (("shrink", 2_500_000, 1_000_000, []), ("ok", "", "2.50 MB → 1.00 MB")), (("remux", 0, 0, []), ("ok", "", "remux")), (("shrink", None, 5, [("WARN", "w")]), ("fail", "warn", "shrink")),
        (("error", 1, 0, [("ERROR", "no space")]), ("fail", "err", "no space")), (("error", 1, 0, []), ("fail", "err", "encode failed")), (("error", 1, 0, [("WARN", "x" * 70)]), ("fail", "err", "x" * 58 + "… (see log)")),
        (("skip-codec", 1, 0, []), ("skip", "", "unsupported codec")), (("skip-codec", 1, 0, [("WARN", "bad")]), ("fail", "warn", "couldn't read file")), (("skip-modern", 1, 0, [("NOTE", "n")]), ("skip", "note", "already modern")),
        (("skip-strange-case", 1, 0, [("WARN", "n")]), ("fail", "warn", "strange case")),
    ],
)
def test_lines_of_a_list(spark, row, said):
    outcome, src, out, notes = row
    r = report.listed(spark.createDataFrame([("/a", outcome, src, out, notes)], RESULTS)).first()
    assert (r.bucket, r.severity, r.label) == said
