import json

import pytest
from pyspark.sql import functions as F

from reelmill.functions.names import extension, stem
from reelmill import settings
from reelmill.operators import detail, history, report
from reelmill.plans import library as plans
from reelmill.settings import Settings
from reelmill.streaming import live
from reelmill.sources import library, probe


@pytest.fixture
def folder(tmp_path):
    for name, size in (("keep.mkv", 20), ("A.MKV", 5), ("_x.mkv", 5), (".x.mkv", 5), ("._x.mkv", 5), (".mkv", 5), ("a.b.mkv", 5), ("notes.txt", 5), ("originals/old.mkv", 5), ("deep/er/é x=1.mp4", 7), ("deep/archived/z.mkv", 5), ("converted/c.mkv", 5), ("keepers/film.mkv", 5)):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    return tmp_path


def names(rows):
    return sorted(r.name for r in rows.collect())


def test_scan_keeps_hidden_names_and_prunes_folders(spark, folder):
    found = library.scan(spark, Settings(src=str(folder)))
    assert names(found) == sorted(["keep.mkv", "A.MKV", "_x.mkv", ".x.mkv", "a.b.mkv", "é x=1.mp4", "c.mkv", "film.mkv"])
    left = library.scan(spark, Settings(src=str(folder), output_mode="separate", output_dir=str(folder / "converted"), ignore_under=6))
    assert names(library.work(left)) == sorted(["keep.mkv", "é x=1.mp4"])


def test_name_parts(spark):
    rows = [("a.mkv", "mkv", "a"), (".mkv", "", ".mkv"), ("a.", "", "a."), ("a.b.MKV", "mkv", "a.b"), ("a", "", "a")]
    for r in spark.createDataFrame(rows, "n string, e string, s string").select("e", "s", extension(F.col("n")).alias("x"), stem(F.col("n")).alias("y")).collect():
        assert (r.x, r.y) == (r.e, r.s)


def test_probe_documents(spark):
    video = {"codec_type": "video", "codec_name": "h264", "width": "1920", "height": "1080", "avg_frame_rate": "0/0", "r_frame_rate": "24000/1001", "tags": {"number_of_bytes": "900000"}}
    cover = {"codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}}
    sound = {"codec_type": "audio", "codec_name": "DTS", "channels": "6", "bit_rate": "1000", "tags": {"language": "eng"}}
    text = {"codec_type": "subtitle", "codec_name": "subrip", "disposition": {"forced": 1}}
    full = {"streams": [cover, video, sound, text], "format": {"bit_rate": "800000", "duration": "10", "tags": {"comment": "x", "reelmill_mode": "shrink"}}}
    stale = {"streams": [video | {"bit_rate": "9017498"}], "format": {"bit_rate": "5374111", "duration": "nan"}}
    docs = [(1, json.dumps(full)), (2, json.dumps(stale)), (3, json.dumps({"error": "gone"})), (4, "no json"), (5, None), (6, json.dumps({"streams": [], "format": {}}))]
    a, b, *rest = probe.normalised(spark.createDataFrame(docs, "id long, document string")).orderBy("id").collect()
    assert (a.vcodec, a.pixels, round(a.fps, 3), a.bit_rate, a.audio_bps, a.comment) == ("h264", 2073600, 23.976, 720000, 1000, "x")
    assert a.audio[0].codec == "dts" and a.audio[0].language == "eng" and a.subtitles[0].forced and a.subtitles[0].is_text and a.own_tags == {"REELMILL_MODE": "shrink"}
    assert (b.bit_rate, b.duration, b.audio) == (0, 0.0, [])
    assert [(r.ok, r.vcodec, r.bit_rate) for r in rest] == [(False, None, 0)] * 3 + [(True, None, 0)]


def test_probe_rows_never_fail(spark):
    scan = spark.createDataFrame([("/nowhere/a.mkv",)], "path string")
    assert not probe.normalised(probe.probed(scan)).first().ok


def test_ledger_round_trip(spark, tmp_path):
    s, path = Settings(), str(tmp_path / "ledger")
    files = spark.createDataFrame([("/a b.mkv", 5, 7), ("/c.mkv", 6, 8)], "path string, size long, mtime long")
    keyed = history.keyed(files, s)
    history.append_ledger(keyed.where("size = 5"), path)
    ledger = history.read_ledger(spark, path)
    assert [r.path for r in history.resumed(keyed, ledger, s).collect()] == ["/a b.mkv"]
    assert [r.path for r in history.pending(keyed, ledger, s).collect()] == ["/c.mkv"]
    assert history.pending(history.keyed(files, Settings(tier="GOOD")), ledger, s).count() == 2
    assert history.pending(keyed.withColumn("mtime", F.lit(0).cast("long")), ledger, s).count() == 2
    assert history.resumed(keyed, ledger, Settings(ledger_enabled=False)).count() == 0


def test_a_pool_of_probes_leaves_raising_ones_out(spark):
    scan = spark.createDataFrame([(f"/{i}",) for i in range(30)], "path string")

    def probing(path):
        if path.endswith("7"):
            raise ValueError(path)
        return f"doc {path}"

    rows = probe.probed(scan, probing).collect()
    assert {r.path for r in rows} == {f"/{i}" for i in range(30) if i % 10 != 7} and all(r.document == f"doc {r.path}" for r in rows)


def test_ledger_is_cleared_and_gone_files_match(spark, tmp_path):
    s, path = Settings(), str(tmp_path / "ledger")
    files = spark.createDataFrame([("/a.mkv", None, None), ("/c.mkv", 6, 8)], "path string, size long, mtime long")
    keyed = history.keyed(files, s)
    history.append_ledger(keyed, path)
    assert history.resumed(keyed, history.read_ledger(spark, path), s).count() == 2
    assert history.clear_ledger(spark, path) == 2 and history.ledger_lines(spark, path) == 0


def test_disposals_are_counted(spark):
    done = spark.createDataFrame([("archived", ""), ("archived", ""), ("deleted", "gone"), ("kept", "")], "fate string, error string")
    assert {(r.fate, r.done, r.failed) for r in report.disposals(done).collect()} == {("archived", 2, 0), ("deleted", 0, 1), ("kept", 1, 0)}


def test_provenance_arguments(spark):
    rows = spark.createDataFrame([("shrink", 4000, None), ("remux", 0, "notes")], "mode string, target_kbps long, comment string")
    a, b = [r.p for r in rows.select(detail.provenance(Settings(), F.lit("2024-01-31").cast("date"), F.col("comment")).alias("p")).collect()]
    assert "REELMILL_TARGET_KBPS=4000" in a and a[-1] == "comment=Reelmill 0.2 — shrink to H.265 at quality 169 on 2024-01-31" and "BPS=" in a
    assert b[-1] == "_STATISTICS_WRITING_DATE_UTC-eng=" and "REELMILL_MODE=remux" in b and not any(x.startswith("REELMILL_TARGET") for x in b)


def test_progress_lines_and_previews(spark):
    rows = spark.createDataFrame([("fps=25.0",), ("bitrate= 800kbits/s",), ("out_time_ms=5000000",), ("speed=2x",), ("junk",)], "line string")
    got = [tuple(r.t) for r in rows.select(live.told(F.col("line"), F.lit(10.0)).alias("t")).collect()]
    assert got == [("25.0", None, None, None), (None, "800kbits/s", None, None), (None, None, None, 0.5), (None, None, "2x", None), (None,) * 4]
    view = lambda d, s=None: tuple(spark.range(1).select(detail.preview(F.lit(float(d)), None if s is None else F.lit(s)).alias("p")).first().p)
    assert [view(100), view(100, 0.2), view(100, 1.5), view(3)] == [(50.0, 5.0), (20.0, 5.0), (95.0, 5.0), (0.0, 3.0)]


def test_estimate_states_and_stream(spark, tmp_path):
    plan = spark.createDataFrame([(100, 60, "shrink"), (50, 50, None)], "size long, predicted long, mode string")
    assert [plans.estimate_state(plan, 2, True), plans.estimate_state(plan.limit(0), 2, False), plans.estimate_state(plan.limit(0), 0, True)] == ["ready", "probing", "empty"]
    assert plans.mean_work(spark.createDataFrame([], "mode string, duration double, pixels long")).first().mean == 50.0
    plan.write.parquet(f"{tmp_path}/t")
    stream = live.stream(spark, f"{tmp_path}/t", plan.schema)
    got = live.newest(live.drained(live.running_estimate(stream, 4), "complete", f"{tmp_path}/out"))
    assert got.collect() == plans.estimate(plan, 4).collect()


def test_sessions(tmp_path):
    kept = tmp_path / "s.json"
    kept.write_text(json.dumps({"src": str(tmp_path), "tier": "GOOD"}))
    assert settings.saved(str(kept))["tier"] == "GOOD" and settings.saved("/nowhere") == {}
    kept.write_text(json.dumps({"src": "/nowhere"}))
    assert settings.saved(str(kept)) == {}
    assert not settings.changed({"a": 1, "b": [2]}, {"b": [2], "a": 1}) and settings.changed({"a": 1}, {"a": 2})
