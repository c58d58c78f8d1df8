"""The decision, prediction, container and subtitle tables, boundaries included."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.operators import paths, predict, report, rules, tracks
from reelmill.plans.library import decided, planned
from reelmill.settings import Settings

S = Settings()
DDL = (
    "path string, ext string, vcodec string, pixels long, fps double, bit_rate long, container_bit_rate long, audio_bps long, audio array<struct<codec:string,channels:int>>, "
    "duration double, size long, own_work boolean"
)


def media(spark, rows):
    base = {"path": "/lib/x.mp4", "ext": "mp4", "vcodec": "h264", "pixels": 2073600, "fps": 24.0, "bit_rate": 0, "container_bit_rate": 0, "audio_bps": 0, "audio": [], "duration": 7200.0, "size": 10**10, "own_work": False}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], DDL)


def target(spark, s, px, fps, source=None):
    return spark.range(1).select(q.target_kbps(s, F.lit(px).cast("long"), F.lit(float(fps)), None if source is None else F.lit(float(source))).alias("t")).first().t


@pytest.mark.parametrize(
    ("changes", "px", "fps", "source", "expected"),
    [
        ({"codec": "h264"}, 2073600, 30, None, 10500), ({"codec": "h264", "tier": "GOOD"}, 2073600, 30, None, 8000), ({"codec": "h264", "tier": "INSANE"}, 2073600, 30, None, 15499),
        ({}, 2073600, 30, None, 6300), ({}, 8294400, 30, None, 21000), ({"codec": "h264"}, 8294400, 24, None, 33600), ({"codec": "h264"}, 2073600, 30, 5000, 5000),
        ({"tier": "OK"}, 19200, 24, None, 1500), ({"tier": "OK", "floor_kbps": 3000}, 19200, 24, None, 3000), ({"hevc": (0.3, 0.5, 0.45)}, 2073600, 30, None, 3150),
        ({"codec": "h264"}, 2073600, 0, None, 10500),
    ],
)
def test_targets(spark, changes, px, fps, source, expected):
    assert target(spark, replace(S, **changes), px, fps, source) == expected


def test_classes(spark):
    names = ["h264", "AVC", " hevc ", "av1", "vp9", "mpeg2video", "wmv3", "prores", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(q.codec_class(F.col("n")).alias("c")).collect()
    assert [r.c for r in rows] == ["h264", "h264", "modern", "modern", "modern", "legacy", "legacy", "other", "other"]


def test_decisions(spark):
    t = target(spark, S, 2073600, 24)
    rate = lambda x: {"bit_rate": int(x * 1000)}
    rows = [rate(t * 1.05), rate(t * 0.4), rate(30000), {"ext": "mkv", "vcodec": "hevc", **rate(30000)}, {"ext": "avi", "vcodec": "mpeg4", **rate(8000)}, {"own_work": True, **rate(20000)}, {"vcodec": None}, {"vcodec": "prores"}, {"vcodec": "mpeg4"}, {}]
    got = [(r.mode or r.outcome, r.target_kbps) for r in decided(media(spark, rows), S).collect()]
    assert got == [("skip-at-tier", 0), ("skip-under-tier", 0), ("shrink", t), ("remux", 0), ("transcode", 6800), ("skip-second-generation", 0), ("skip-codec", 0), ("skip-codec", 0), ("transcode", 1500), ("skip-at-tier", 0)]
    shrink = lambda s, r: decided(media(spark, [r]), s).first()
    assert shrink(replace(S, leave_non_mp4=True), rows[3]).outcome == "skip-non-mp4"
    assert shrink(replace(S, compat_transcode=False), rows[4]).outcome == "skip-incompatible"
    assert shrink(replace(S, allow_second_generation=True), rows[5]).mode == "shrink"
    assert shrink(replace(S, remux_to_mp4=False), rows[3]).outcome == "skip-modern"


def test_boundaries_of_the_shrink_gates(spark):
    s = replace(S, codec="h264", tolerance=1.0, min_saving_ratio=1.0)
    t = target(spark, s, 2073600, 24)
    got = [r.mode or r.outcome for r in decided(media(spark, [{"bit_rate": t * 1000}, {"bit_rate": t * 1000 + 1}]), s).collect()]
    assert got == ["skip-at-tier", "shrink"]


def test_effective_rate(spark):
    dts = [("truehd", 6)]
    rows = [{"container_bit_rate": 12_100_000, "audio_bps": 3_100_000}, {"container_bit_rate": 12_100_000, "bit_rate": 9_017_498}, {"container_bit_rate": 12_000_000, "audio": dts}, {"container_bit_rate": 12_000_000, "audio": dts, "audio_bps": 3_110_857}, {}, {"container_bit_rate": 100, "audio_bps": 500}]
    assert [r.effective_bps for r in rules.with_rates(media(spark, rows)).collect()] == [9_000_000, 9_017_498, 9_000_000, 8_889_143, 0, 100]


def test_predicted_sizes(spark):
    row = {"bit_rate": 10_000_000, "audio": [("ac3", 6)], "size": int(13e6 / 8 * 7200)}
    plan = rules.with_rates(media(spark, [row])).withColumn("mode", F.lit("shrink")).withColumn("target_kbps", F.lit(2500).cast("long"))
    assert predict.predicted(plan, S).first().predicted == 4_950_000_000
    assert predict.predicted(plan, replace(S, audio_policy="aac")).first().predicted == 2_653_200_000
    assert predict.predicted(plan.withColumn("mode", F.lit("remux")), S).first().predicted == row["size"]


def test_containers_and_audio(spark):
    a = lambda *c: [(x, n) for x, n in c]
    rows = [("mp4", [], ["pgs"]), ("mp4", [], []), ("mp4", a(("dts", 6)), []), ("mp4", a(("aac", 2)), []), ("avi", [], []), ("mkv", [], ["subrip"])]
    df = spark.createDataFrame(rows, "ext string, audio array<struct<codec:string,channels:int>>, s array<string>").withColumn("subtitles", F.transform("s", lambda c: F.struct(c.alias("codec"))))
    of = lambda s: [r.c for r in df.select(tracks.container(s, F.col("ext"), F.col("audio"), F.col("subtitles"))["container"].alias("c")).collect()]
    assert of(S) == ["mkv", "mp4", "mkv", "mp4", "mp4", "mp4"]
    assert of(replace(S, container="mp4", keep_image_subs=False, keep_mkv_for_audio=False)) == ["mp4"] * 6
    assert of(replace(S, audio_policy="flac")) == ["mkv"] * 6
    assert of(replace(S, keep_source_container=True)) == ["mkv", "mp4", "mp4", "mp4", "mkv", "mkv"]
    assert of(replace(S, container="mp4", keep_image_subs=False, keep_mkv_for_audio=False, mkv_if_text_subs=True)) == ["mkv", "mp4", "mp4", "mp4", "mp4", "mp4"]
    says = lambda s, kind: [r.s for r in df.select(tracks.audio_plan(s, F.lit(kind), F.col("audio"))["says"].alias("s")).collect()]
    assert says(S, "mp4") == ["no audio", "no audio", "AAC 448k", "copied", "no audio", "no audio"]
    assert says(replace(S, audio_policy="ac3"), "mp4")[2] == "AC-3 448k" and says(replace(S, audio_policy="flac"), "mkv")[3] == "FLAC" and says(S, "mkv")[2] == "copied"


def test_subtitle_choice(spark):
    subs = [("eng", False, False), ("eng", True, False), ("eng", False, True), ("fre", False, False), ("fre", True, False), ("spa", True, True)]
    df = spark.createDataFrame([([(i, *s) for i, s in enumerate(subs)],)], "s array<struct<index:int,language:string,forced:boolean,hearing_impaired:boolean>>")

    def kept(langs=(), kinds=()):
        return [x["index"] for x in df.select(tracks.kept_subtitles(replace(S, sub_langs=langs, sub_kinds=kinds), F.col("s")).alias("k")).first().k]

    assert kept() == [0, 1, 2, 3, 4, 5] and kept(("eng",)) == [0, 1, 2] and kept(("eng", "fre")) == [0, 1, 2, 3, 4]
    assert kept(kinds=("forced",)) == [1, 4, 5] and kept(kinds=("normal",)) == [0, 3] and kept(kinds=("hoh",)) == [2, 5]
    assert kept(("eng",), ("forced",)) == [1] and kept(("fre",), ("normal",)) == [3]


def test_ignore_rules(spark):
    s = replace(S, ignore_under=1_000_000, ignore_over=500_000_000, ignore_exts=("avi",), ignore_names=("sample",))
    rows = [("keep.mkv", 50_000_000), ("tiny.mkv", 500_000), ("huge.mkv", 900_000_000), ("OLD.AVI", 50_000_000), ("movie-Sample.mkv", 50_000_000), ("unknown.mkv", None), ("avi.mkv", 50_000_000), ("edge.mkv", 1_000_000)]
    got = [r.r is None for r in spark.createDataFrame(rows, "n string, size long").select(rules.ignore_reason(F.col("n"), F.col("size"), s).alias("r")).collect()]
    assert got == [True, False, False, False, False, True, True, True]


def test_gates_and_fates(spark):
    rows = [("shrink", 100, 75), ("shrink", 100, 74), ("transcode", 1000, 1004), ("transcode", 1000, 1006), ("remux", 100, 500)]
    df = spark.createDataFrame(rows, "mode string, a long, b long")
    assert [r.t for r in df.select(paths.size_gate(F.col("mode"), F.col("a"), F.col("b"), 0.75).alias("t")).collect()] == [True, False, False, True, False]
    fate = lambda action, out, lost: spark.range(1).select(paths.fate(replace(S, source_action=action), F.lit(out), F.lit("a"), F.lit(lost)).alias("f")).first().f
    assert [fate("archive", "a", ""), fate("archive", "b", ""), fate("delete", "a", ""), fate("delete", "a", "x"), fate("delete", "b", ""), fate("keep", "b", "x")] == ["archived-first", "archived", "overwritten", "archived-first", "deleted", "kept"]


def test_report(spark):
    rows = [("a", "shrink", 1000, 400, []), ("b", "shrink", 2000, 1000, []), ("c", "remux", 500, 500, []), ("d", "skip-at-tier", 0, 0, []), ("e", "skip-modern", 0, 0, []), ("f", "resume", 0, 0, []), ("g", "error", 0, 0, [("ERROR", "encode failed")])]
    df = spark.createDataFrame(rows, "path string, outcome string, src_bytes long, out_bytes long, notes array<struct<level:string,message:string>>")
    t = report.tally(df).first()
    assert (t.total, t.changed, t.left_alone, t.errors) == (7, 3, 3, 1)
    saved = report.space_saved(df).first()
    assert (saved.before, saved.after, round(saved.percent, 1)) == (3500, 1900, 45.7)
    assert report.space_saved(df.where("outcome = 'resume'")).first() is None
    text = "\n".join(r.line for r in report.lines(df).orderBy("part", "nth", "path").collect())
    assert "7 files" in text and "encode failed" in text and "45.7%" in text


def test_list_rows(spark):
    rows = [("/a/b.mkv", "shrink", 1_900_000_000, 463_740_000, []), ("c", "remux", 0, 0, []), ("d", "skip-codec", 0, 0, [("WARN", "no")]), ("e", "error", 0, 0, [("ERROR", "x" * 70)]), ("f", "error", 5, 5, []), ("g", "skip-at-tier", 9, 0, [("INFO", "i")]), ("h", "skip-odd-one", 0, 0, []), ("i", "transcode", 999, 1000, [])]
    df = spark.createDataFrame(rows, "path string, outcome string, src_bytes long, out_bytes long, notes array<struct<level:string,message:string>>")
    got = {r.path: (r.bucket, r.severity, r.label) for r in report.listed(df).collect()}
    assert got["/a/b.mkv"] == ("ok", "", "1.90 GB → 463.74 MB") and got["c"] == ("ok", "", "remux") and got["d"] == ("fail", "warn", "couldn't read file")
    assert got["e"] == ("fail", "err", "x" * 58 + "… (see log)") and got["f"] == ("fail", "err", "encode failed") and got["g"] == ("skip", "note", "already efficient")
    assert got["h"] == ("skip", "", "odd one") and got["i"] == ("ok", "", "999 B → 1.00 KB")
    assert sorted(r.path for r in report.failed(df).collect()) == ["e", "f"]


def test_a_second_run_changes_nothing(spark):
    """What a shrink makes is at its tier: deciding again leaves it."""
    first = planned(media(spark, [{"bit_rate": 30_000_000}]), replace(S, codec="h264")).first()
    again = decided(media(spark, [{"bit_rate": first.target_kbps * 1000}]), replace(S, codec="h264")).first()
    assert first.mode == "shrink" and again.outcome == "skip-at-tier"


def test_decisions_run_without_python(spark):
    plan = planned(media(spark, [{}]), S)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
