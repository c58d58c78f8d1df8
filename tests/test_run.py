"""A whole run with a stand-in encoder and probe, begun again, with outputs in the way and a lost volume."""

import json
import os

import pytest

from reelmill.operators import history
from reelmill.plans import run as runs
from reelmill.settings import Settings

DDL = (
    "path string, name string, ext string, vcodec string, pix_fmt string, width int, height int, pixels long, fps double, bit_rate long, container_bit_rate long, audio_bps long, "
    "audio array<struct<index:int,codec:string,channels:int,language:string>>, subtitles array<struct<index:int,codec:string,is_text:boolean,language:string,forced:boolean,hearing_impaired:boolean>>, "
    "duration double, size long, mtime long, own_work boolean, comment string, ok boolean"
)
BIG, SMALL = 40_000_000, 2_000_000


@pytest.fixture
def library(spark, tmp_path):
    """big.mkv shrinks, grown.mkv would not get smaller, old.avi is transcoded, bad.mkv fails, small.mp4 is fine, lost.mkv has image subtitles, twin folders share a name."""
    rows = []

    def film(name, bit_rate=BIG, vcodec="h264", subtitles=(), ok=True):
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("o" * 1000)
        ext = name.rsplit(".", 1)[1]
        rows.append((str(path), os.path.basename(name), ext, vcodec, "yuv420p", 1920, 1080, 2073600, 24.0, bit_rate, bit_rate, 0, [(1, "aac", 2, "eng")], [(i, c, c == "subrip", "eng", False, False) for i, c in enumerate(subtitles, 2)], 100.0, 1000, 7, False, "", ok))

    film("big.mkv", subtitles=("subrip",))
    film("grown.mkv")
    film("old.avi", vcodec="mpeg4")
    film("bad.mkv")
    film("short.mkv")
    film("small.mp4", bit_rate=3_000_000)
    film("lost.mkv", subtitles=("hdmv_pgs_subtitle",))
    film("a/twin.mkv")
    film("b/twin.mkv")
    film("unread.mkv", vcodec=None, ok=False)
    return spark.createDataFrame(rows, DDL)


@pytest.fixture
def tools():
    """A stand-in encoder and a stand-in probe, sent to the tasks by value."""
    def encode(command, out, say):
        source = command[command.index("-i") + 1]
        say("out_time_ms=50000000")
        if "bad" in source:
            return "one / two"
        with open(out, "w") as f:
            f.write(("s" if "short" in source else "n") * (990 if "grown" in source else 400))
        return ""

    def look(path):
        with open(path) as f:
            cut = f.read(1) == "s"
        return json.dumps({"streams": [{"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080}], "format": {"duration": "10" if cut else "100", "bit_rate": "1"}})

    return encode, look


def settings(tmp_path):
    return Settings(src=str(tmp_path / "lib"), output_mode="separate", output_dir=str(tmp_path / "out"), output_flat=True, container="mp4", keep_image_subs=False, source_action="delete", compat_transcode=True)


def outcomes(results):
    return {r.path.split("/lib/")[1]: r.outcome for r in results.collect()}


FIRST = {
    "big.mkv": "shrink", "grown.mkv": "skip-min-saving", "old.avi": "transcode", "bad.mkv": "error", "short.mkv": "error", "small.mp4": "skip-under-tier", "lost.mkv": "shrink",
    "a/twin.mkv": "shrink", "b/twin.mkv": "skip-existing", "unread.mkv": "skip-codec",
}


def test_a_run_and_the_next_one(spark, library, tools, tmp_path):
    s, places = settings(tmp_path), runs.Places(*(str(tmp_path / n) for n in ("stage", "journal", "ledger", "progress")))
    first = runs.run(library, s, places, *tools, every=0.0)
    assert outcomes(first) == FIRST
    assert sorted(os.listdir(tmp_path / "out")) == ["big.mp4", "lost.mp4", "old.mp4", "twin.mp4"] and not (tmp_path / "stage").exists()
    there = {n: os.path.exists(tmp_path / "lib" / n) for n in FIRST}
    assert there == {n: n not in ("big.mkv", "old.avi", "a/twin.mkv", "lost.mkv") for n in FIRST}
    archived = [n for at, _, names in os.walk(s.archive) for n in names]
    assert archived == ["lost.mkv"]  # what the output couldn't hold keeps its original
    notes = {r.path.rsplit("/", 1)[1]: [n.message for n in r.notes] for r in first.collect() if r.notes}
    assert notes == {"bad.mkv": ["one / two"], "short.mkv": ["the output can't stand in for its source"], "lost.mkv": ["original kept: image tracks"]}
    assert history.ledger_lines(spark, places.ledger) == 7 and len(os.listdir(tmp_path / "progress")) == 7
    again = runs.run(library, s, places, *tools, every=0.0)
    tried = {"bad.mkv": "error", "short.mkv": "error", "unread.mkv": "skip-codec"}
    assert outcomes(again) == {n: tried.get(n, "resume") for n in FIRST} and history.ledger_lines(spark, places.ledger) == 7
    other = runs.run(library.where("name = 'small.mp4'"), Settings(**{**s.__dict__, "tier": "GOOD"}), places, *tools, every=0.0)
    assert list(outcomes(other).values()) != ["resume"]


def test_outputs_that_exist_and_a_stopped_run(spark, library, tools, tmp_path):
    s = settings(tmp_path)
    places = runs.Places(*(str(tmp_path / n) for n in ("stage", "journal", "ledger")), stop=str(tmp_path / "stop"))
    listing = spark.createDataFrame([(f"{s.output_dir}/big.mp4",)], "path string")
    (tmp_path / "stop").touch()
    found = outcomes(runs.run(library.where("name in ('big.mkv', 'old.avi', 'small.mp4')"), s, places, *tools, listing, every=0.0))
    assert found == {"big.mkv": "skip-existing", "small.mp4": "skip-under-tier"} and not (tmp_path / "out").exists()
    (tmp_path / "stop").unlink()
    found = outcomes(runs.run(library.where("name in ('big.mkv', 'old.avi', 'small.mp4')"), s, places, *tools, listing, every=0.0))
    assert found == {"big.mkv": "resume", "small.mp4": "resume", "old.avi": "transcode"}
