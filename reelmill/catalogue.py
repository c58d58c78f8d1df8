"""Every planning query by name, and its oracle SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmill import oracle as o
from reelmill import tables
from reelmill.functions import quality as q
from reelmill.functions.names import cut_tail, extension, stem
from reelmill.operators import detail, execute, history, paths, predict, progress, report, rules, tracks, volumes
from reelmill.plans import library as plans
from reelmill.settings import TIER_MBPS, Settings
from reelmill.sources import media, probe
from reelmill.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
S = Settings()
#: A comment of ours in a file; the documents' texts stand for comments.
MARK = "reelmill"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def plan(spark, d: str, s: Settings = S, subtitles: bool = False) -> DataFrame:
    return plans.planned(media.library(spark, d, subtitles), s)


# decisions -------------------------------------------------------------------------------------------------------


@query("decide_outcome_counts", o.planning(S) + " SELECT ruling AS result, count(*) AS files, sum(target_kbps)::bigint AS kbps FROM decided GROUP BY ruling")
def _(spark, d):
    return plan(spark, d).groupBy(F.coalesce("mode", "outcome").alias("result")).agg(F.count("*").alias("files"), F.sum("target_kbps").alias("kbps"))


DECISION = ["file_id", "mode", "outcome", "target_kbps"]


def _decisions(name: str, s: Settings) -> None:
    query(name, o.planning(s) + " SELECT file_id, mode, outcome, target_kbps::bigint AS target_kbps FROM decided")(lambda spark, d: plan(spark, d, s).select(*DECISION))


_decisions("decide_rows", S)
_decisions("decide_strict_policy", replace(S, leave_non_mp4=True))
_decisions("decide_no_transcode", replace(S, compat_transcode=False))
_decisions("decide_no_remux", replace(S, remux_to_mp4=False))
_decisions("decide_allow_second_generation", replace(S, allow_second_generation=True))
_decisions("decide_h264_good_wide", replace(S, codec="h264", tier="GOOD", tolerance=1.25))
TUNED = replace(S, tier="STELLAR", tier_bpp={"STELLAR": 0.12}, hevc=(0.30, 0.40, 0.35), floor_kbps=3000)
_decisions("decide_retuned", TUNED)


def _targets(settings: list[Settings]) -> tuple:
    name = lambda s: f"{s.tier.lower()}_{s.codec}"
    sql = f"WITH {o.FILES.strip()} SELECT file_id, " + ", ".join(f"trunc({o.raw_target(s)})::bigint AS {name(s)}" for s in settings) + " FROM files"
    return sql, lambda spark, d: media.files(spark, d).select("file_id", *[q.target_kbps(s, F.col("pixels"), F.col("fps")).alias(name(s)) for s in settings])


for _name, _settings in (("tier_targets", [replace(S, tier=t, codec=c) for t in TIER_MBPS for c in ("h264", "h265")]), ("tier_retuned_targets", [TUNED, replace(TUNED, codec="h264"), replace(TUNED, tier="OK")])):
    _sql, _plan = _targets(_settings)
    query(_name, _sql)(_plan)


@query("source_density", o.planning(S) + " SELECT file_id, CASE WHEN pixels > 0 AND fps > 0 THEN effective_bps / (pixels * fps) ELSE 0.0::double END AS density, CASE WHEN fps > 0 THEN target_kbps * 1000.0::double / (pixels * fps) ELSE 0.0::double END AS planned_density FROM decided")
def _(spark, d):
    fps, px = F.col("fps"), F.col("pixels")
    return plan(spark, d).select("file_id", q.source_density(F.col("effective_bps"), px, fps).alias("density"), q.source_density(F.col("target_kbps") * 1000.0, px, fps).alias("planned_density"))


@query("effective_bitrate", o.planning(S) + " SELECT file_id, effective_bps::bigint AS effective_bps, max_channels::int AS max_channels, n_audio::int AS n_audio FROM rated")
def _(spark, d):
    return rules.with_rates(media.library(spark, d)).select("file_id", "effective_bps", q.max_channels(F.col("audio")).alias("max_channels"), F.size("audio").alias("n_audio"))


# predictions -----------------------------------------------------------------------------------------------------


def _sizes(name: str, s: Settings) -> None:
    query(name, o.planning(s) + " SELECT file_id, mode, predicted::bigint AS predicted FROM sized")(lambda spark, d: plan(spark, d, s).select("file_id", "mode", "predicted"))


_sizes("predict_sizes", S)
_sizes("predict_sizes_aac", replace(S, audio_policy="aac"))


@query("projected_saving", o.planning(S) + " SELECT file_id, saving FROM planned")
def _(spark, d):
    return plan(spark, d).select("file_id", "saving")


ESTIMATE_SQL = """ SELECT src_bytes::bigint AS src_bytes, out_bytes::bigint AS out_bytes, round_even((1 - out_bytes / src_bytes::double) * 100, 0)::bigint AS saved_pct,
  round_even(encoded * k, 0)::bigint AS reencoded, round_even((n - encoded) * k, 0)::bigint AS skipped, work_src * k AS work_bytes, work_out * k AS work_out_bytes,
  greatest(0, work_src - work_out) * k AS work_saved_bytes, CASE WHEN work_src > 0 THEN round_even((1 - work_out / work_src::double) * 100, 0) ELSE 0 END::bigint AS work_saved_pct
FROM (SELECT *, {k} AS k FROM (SELECT count(*) AS n, sum(size)::bigint AS src_bytes, sum(predicted)::bigint AS out_bytes, count(*) FILTER (mode IN ('shrink', 'transcode')) AS encoded,
  sum(size) FILTER (mode IN ('shrink', 'transcode'))::bigint AS work_src, sum(predicted) FILTER (mode IN ('shrink', 'transcode'))::bigint AS work_out FROM planned))"""


@query("estimate_totals", o.planning(S) + ESTIMATE_SQL.format(k="1.0::double"))
def _(spark, d):
    return plans.estimate(plan(spark, d))


@query("estimate_partial_scale", o.planning(S) + ESTIMATE_SQL.format(k="123456.0::double / n"))
def _(spark, d):
    return plans.estimate(plan(spark, d), 123456)


CANDIDATES_SQL = """, candidates AS (SELECT file_id, path, size AS bytes, width || 'x' || height AS resolution, duration,
  round_even(CASE WHEN source_kbps > 0 THEN greatest(0.0::double, 1.0::double - target_kbps / source_kbps) ELSE 0.0::double END * 100, 0)::bigint AS saving
  FROM planned WHERE mode IN ('shrink', 'transcode'))"""


@query("reencode_candidates", o.planning(S) + CANDIDATES_SQL + " SELECT * FROM candidates")
def _(spark, d):
    return plans.candidates(plan(spark, d))


@query("reencode_candidates_top", o.planning(S) + CANDIDATES_SQL + " SELECT * FROM candidates ORDER BY bytes DESC, file_id LIMIT 100")
def _(spark, d):
    return plans.candidates(plan(spark, d)).orderBy(F.desc("bytes"), "file_id").limit(100)


@query("dry_run_totals", o.planning(S) + """ SELECT *, CASE WHEN bytes > 0 THEN saved / bytes::double * 100 ELSE 0.0::double END AS percent FROM (
  SELECT count(*) AS files, count(*) FILTER (saving > 0) AS saving_files, coalesce(sum(size) FILTER (saving > 0), 0)::bigint AS bytes, coalesce(sum(floor(size * saving)::bigint) FILTER (saving > 0), 0)::bigint AS saved FROM planned)""")
def _(spark, d):
    return plans.dry_run_totals(plan(spark, d))


@query("dry_run_table", o.planning(S) + """ SELECT file_id, name, width || 'x' || height AS resolution, round_even(source_kbps / 1000, 1) AS source_m, round_even(target_kbps / 1000.0::double, 1) AS target_m, ruling AS action,
  round_even(saving * 100, 0) AS saving_pct FROM planned""")
def _(spark, d):
    return plans.dry_run(plan(spark, d)).select(
        "file_id", cut_tail(F.col("name"), 44).alias("name"), F.concat_ws("x", "width", "height").alias("resolution"), F.bround(F.col("source_kbps") / 1000, 1).alias("source_m"),
        F.bround(F.col("target_kbps") / 1000.0, 1).alias("target_m"), F.coalesce("mode", "outcome").alias("action"), F.bround(F.col("saving") * 100, 0).alias("saving_pct"),
    )


# scan and ignore rules -------------------------------------------------------------------------------------------

IGNORE = replace(S, ignore_under=300_000, ignore_over=9_000_000, ignore_exts=(".AVI",), ignore_names=("sample", "the on"))
IGNORE_CASE = """CASE WHEN size < 300000 THEN 'smaller than the limit' WHEN size > 9000000 THEN 'larger than the limit' WHEN name LIKE '%.avi' THEN 'ending .avi is ignored'
  WHEN contains(lower(name), 'sample') THEN 'name has sample' WHEN contains(lower(name), 'the on') THEN 'name has the on' END"""


def _entries(spark, d: str) -> DataFrame:
    return media.named_files(spark, d).withColumn("reason", rules.ignore_reason(F.col("name"), F.col("size"), IGNORE))


@query("ignore_reasons", f"WITH {o.NAMED.strip()} SELECT reason, count(*) AS files, sum(size)::bigint AS bytes FROM (SELECT *, {IGNORE_CASE} AS reason FROM named) GROUP BY reason")
def _(spark, d):
    return _entries(spark, d).groupBy("reason").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("ignore_kept", f"WITH {o.NAMED.strip()} SELECT doc_id, name, size FROM named WHERE {IGNORE_CASE} IS NULL")
def _(spark, d):
    return _entries(spark, d).where("reason is null").select("doc_id", "name", "size")


@query("scan_totals", f"WITH {o.NAMED.strip()}, e AS (SELECT *, {IGNORE_CASE} AS reason FROM named) SELECT count(*) FILTER (reason IS NULL) AS files, coalesce(sum(size) FILTER (reason IS NULL), 0)::bigint AS bytes, count(*) FILTER (reason IS NULL AND name NOT LIKE '%.mp4') AS not_mp4, count(*) FILTER (reason IS NOT NULL) AS ignored FROM e")
def _(spark, d):
    kept = F.col("reason").isNull()
    return _entries(spark, d).agg(
        F.count_if(kept).alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(kept & (extension(F.col("name")) != "mp4")).alias("not_mp4"), F.count_if(~kept).alias("ignored"),
    )


@query("own_work_by_comment", f"WITH {o.NAMED.strip()} SELECT doc_id FROM named WHERE contains(lower(comment), '{MARK}') AND (contains(lower(comment), 'shrink') OR contains(lower(comment), 'transcode'))")
def _(spark, d):
    return media.named_files(spark, d).where(rules.own_work(None, F.col("comment"), MARK)).select("doc_id")


# history ---------------------------------------------------------------------------------------------------------

#: Written out: the signature of the default settings.
SIGNATURE = "EXCELLENT|h265|rmx1|xc1|inplace"
LEDGER = f"ledger AS (SELECT CASE WHEN file_id % 3 = 0 THEN 'GOOD|h264|rmx1|xc1|inplace' ELSE '{SIGNATURE}' END AS signature, path, size, mtime FROM files WHERE o_orderstatus = 'F')"
HELD = f"EXISTS (SELECT 1 FROM ledger l WHERE l.signature = '{SIGNATURE}' AND l.path = files.path AND l.size = files.size AND l.mtime = files.mtime)"


@query("resume_split", f"WITH {o.FILES.strip()}, {LEDGER} SELECT file_id FROM files WHERE {HELD}")
def _(spark, d):
    return history.resumed(history.keyed(media.files(spark, d), S), media.ledger(spark, d, S), S).select("file_id")


@query("pending_after_resume", f"WITH {o.FILES.strip()}, {LEDGER} SELECT file_id, path FROM files WHERE NOT {HELD}")
def _(spark, d):
    return history.pending(history.keyed(media.files(spark, d), S), media.ledger(spark, d, S), S).select("file_id", "path")


def _stored(spark, d: str) -> DataFrame:
    name = f"ledger_{uuid.uuid4().hex}"
    return history.stored_ledger(media.ledger(spark, d, S), name, tables.place(spark, "ledger"))


@query("resume_stored", f"WITH {o.FILES.strip()}, {LEDGER} SELECT file_id, CASE WHEN {HELD} THEN 'resume' ELSE 'pending' END AS state FROM files")
def _(spark, d):
    files, ledger = media.files(spark, d).select("file_id", "path", "size", "mtime"), _stored(spark, d)
    held, left = (history.held_files(files, ledger, S.signature(), how) for how in ("left_semi", "left_anti"))
    return held.select("file_id", F.lit("resume").alias("state")).unionByName(left.select("file_id", F.lit("pending").alias("state")))


@query("ledger_keys", f"WITH {o.FILES.strip()} SELECT file_id, '{SIGNATURE}' || CASE WHEN file_id % 10 = 0 THEN '|sw' ELSE '' END || chr(9) || path || chr(9) || size || chr(9) || mtime AS line FROM files")
def _(spark, d):
    rows = history.keyed(media.files(spark, d), S, F.col("file_id") % 10 == 0)
    return rows.select("file_id", history.ledger_line(*[F.col(c) for c in history.KEY]).alias("line"))


@query("ledger_size", f"WITH {o.FILES.strip()}, {LEDGER} SELECT signature, count(*) AS lines, count(DISTINCT path) AS paths FROM ledger GROUP BY signature")
def _(spark, d):
    return media.ledger(spark, d, S).groupBy("signature").agg(F.count("*").alias("lines"), F.countDistinct("path").alias("paths"))


@query("probe_cache_fill", o.planning(S) + f", w AS (SELECT path, {o.work()} AS seconds FROM decided WHERE file_id % 2 = 0) SELECT file_id, coalesce(seconds, 50.0::double) AS seconds FROM files LEFT JOIN w USING (path)")
def _(spark, d):
    known = plan(spark, d).where("file_id % 2 = 0").withColumn("seconds", predict.work_seconds(F.lit(False)))
    return history.filled(media.files(spark, d).select("file_id", "path"), known, "seconds", F.lit(50.0)).select("file_id", "seconds")


def _picks(spark, d: str) -> DataFrame:
    return media.files(spark, d).where("file_id % 10 = 0").select("path")


@query("software_picks", o.planning(S) + f" SELECT file_id, file_id % 10 = 0 AS picked, {o.work('file_id % 10 = 0')} AS seconds FROM decided")
def _(spark, d):
    rows = history.with_picks(plan(spark, d), _picks(spark, d))
    return rows.select("file_id", "picked", predict.work_seconds(F.col("picked")).alias("seconds"))


@query("retry_merge", f"""WITH {o.RESULTS.strip()} SELECT event_id, CASE WHEN outcome = 'error' AND event_id % 2 = 0 THEN 'shrink' ELSE outcome END AS outcome,
  CASE WHEN outcome = 'error' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS attempt FROM results""")
def _(spark, d):
    first = media.results(spark, d).select("event_id", "outcome")
    retry = first.where("outcome = 'error' and event_id % 2 = 0").withColumn("outcome", F.lit("shrink"))
    return history.latest(first, retry, ["event_id"])


@query("failed_files", f"WITH {o.RESULTS.strip()} SELECT run, path FROM results WHERE outcome = 'error'")
def _(spark, d):
    rows = media.results(spark, d)
    return rows.join(report.failed(rows), "path", "left_semi").select("run", "path")


LABELS = "CASE outcome WHEN 'error' THEN CASE WHEN level IS NULL THEN 'encode failed' ELSE 'note ' || event_id END WHEN 'skip-at-tier' THEN 'already efficient' ELSE CASE WHEN src_bytes > 0 THEN {src} || ' → ' || {out} ELSE outcome END END"
SHORT = "CASE " + " ".join(f"WHEN {{n}} >= {u} THEN printf('%d.%02d {name}', (({{n}} + {u // 200}) // {u // 100}) // 100, (({{n}} + {u // 200}) // {u // 100}) % 100)" for u, name in ((10**9, "GB"), (10**6, "MB"), (10**3, "KB"))) + " ELSE {n} || ' B' END"


@query("report_rows", f"WITH {o.RESULTS.strip()} SELECT event_id, bucket, CASE WHEN outcome = 'error' THEN 'err' WHEN level = 'WARN' THEN 'warn' WHEN level IS NOT NULL THEN 'note' ELSE '' END AS severity, " + LABELS.format(src=SHORT.format(n="src_bytes"), out=SHORT.format(n="out_bytes")) + " AS label FROM judged")
def _(spark, d):
    return report.listed(media.results(spark, d)).select("event_id", "bucket", "severity", "label")


CONSOLE = """SELECT event_id, 0 AS nth, 'e' || event_id || ': ' || CASE outcome WHEN 'skip-at-tier' THEN 'already efficient' ELSE outcome END
    || CASE WHEN changed AND src_bytes > 0 THEN printf(', %.0f%% smaller', 100 * (1 - out_bytes / src_bytes::double)) ELSE '' END AS line FROM judged
  UNION ALL SELECT event_id, 1 AS nth, '  ' || lower(level) || ': note ' || event_id AS line FROM judged WHERE level IS NOT NULL"""


@query("console_lines", f"WITH {o.RESULTS.strip()} {CONSOLE}")
def _(spark, d):
    said = report.console(media.results(spark, d))
    return said.select(F.regexp_extract("path", r"e(\d+)$", 1).cast("long").alias("event_id"), "nth", "line")


@query("stuck_volumes", "SELECT path, since FROM (SELECT '/vol/' || user_id AS path, max(event_id) AS since, max_by(value > 50, event_id) AS stuck FROM events GROUP BY user_id) WHERE stuck")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    told = rows.select(F.concat(F.lit("/vol/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("at"), F.when(F.col("value") > 50, "stuck").otherwise("back").alias("event"))
    return volumes.stuck_now(told)


# containers, audio, subtitles ------------------------------------------------------------------------------------


def _container_sql(s: Settings) -> str:
    auto = s.container == "auto"
    yes = lambda b: str(bool(b)).lower()
    if s.keep_source_container:
        case = f"CASE WHEN {yes(s.keep_image_subs)} AND n_images > 0 AND ext <> 'mkv' THEN 'image subtitles need Matroska' WHEN ext IN ('mp4', 'm4v', 'mov') THEN '' WHEN ext = 'mkv' THEN 'stays MKV' ELSE 'no modern codec fits the source container' END"
    else:
        case = f"""CASE WHEN {yes(auto or s.keep_image_subs)} AND n_images > 0 THEN 'image subtitles: ' || image_codecs WHEN {yes(auto or s.keep_mkv_for_audio)} AND n_foreign > 0 THEN 'audio: ' || foreign_codecs
          WHEN {yes(s.mkv_if_tracks_over)} AND n_audio + n_subs > {s.mkv_if_tracks_over} THEN 'many tracks' ELSE '' END"""
    return f"contained AS (SELECT *, CASE WHEN reason = '' THEN 'mp4' ELSE 'mkv' END AS container FROM (SELECT *, {case} AS reason FROM media))"


def _contained(spark, d: str, s: Settings) -> DataFrame:
    rows = media.library(spark, d, subtitles=True)
    return rows.withColumn("c", tracks.container(s, F.col("ext"), F.col("audio"), F.col("subtitles"))).select("*", "c.*").drop("c")


def _containers(name: str, s: Settings) -> None:
    query(name, o.planning(S, _container_sql(s)) + " SELECT file_id, container, reason FROM contained")(lambda spark, d: _contained(spark, d, s).select("file_id", "container", "reason"))


FORCED = replace(S, container="mp4", keep_image_subs=False, keep_mkv_for_audio=False, mkv_if_tracks_over=4)
_containers("container_choice", S)
_containers("container_forced_mp4", FORCED)
_containers("container_keep_source", replace(S, keep_source_container=True))


@query("audio_plan", o.planning(S, _container_sql(FORCED)) + """ SELECT file_id, codec, CASE WHEN codec = 'aac' THEN rate END AS kbps, CASE WHEN n_audio = 0 THEN 'no audio' WHEN codec = 'copy' THEN 'copied' ELSE 'AAC ' || rate || 'k' END AS says FROM (
  SELECT *, CASE WHEN container = 'mkv' OR (n_audio > 0 AND n_foreign = 0) THEN 'copy' ELSE 'aac' END AS codec, CASE WHEN max_channels > 2 THEN 448 ELSE 256 END::int AS rate FROM contained)""")
def _(spark, d):
    return _contained(spark, d, FORCED).select("file_id", tracks.audio_plan(FORCED, F.col("container"), F.col("audio")).alias("p")).select("file_id", "p.*")


CAPTION_SQL = """, told AS (SELECT d.*, container, reason, CASE WHEN mode = 'remux' THEN source_kbps ELSE target_kbps::double END AS kbps FROM decided d JOIN (SELECT file_id, container, reason FROM contained) USING (file_id) WHERE mode IS NOT NULL),
  lines AS (SELECT *, CASE WHEN pixels > 0 AND fps > 0 THEN kbps * 1000.0::double / (pixels * fps) ELSE 0 END AS density, CASE WHEN n_audio = 0 THEN 'no audio' WHEN container = 'mkv' OR n_foreign = 0 THEN 'copied' ELSE 'AAC ' || CASE WHEN max_channels > 2 THEN '448k' ELSE '256k' END END AS audio_says,
    CASE WHEN n_subs = 0 THEN '' WHEN container = 'mkv' THEN 'all ' || n_subs ELSE concat_ws('; ', CASE WHEN n_subs > n_images THEN (n_subs - n_images) || ' embedded' END, CASE WHEN n_images > 0 THEN n_images || ' dropped' END) END AS subtitles_say FROM told)
  SELECT file_id, concat_ws(' · ', CASE WHEN ext <> container THEN ext || '→' || container WHEN reason <> '' THEN 'kept ' || container || ': ' || reason ELSE 'kept ' || container END,
    CASE mode WHEN 'remux' THEN vcodec || ' copied' WHEN 'transcode' THEN vcodec || '→hevc transcoded at ' || target_kbps || ' kbps' ELSE vcodec || '→hevc shrunk to ' || target_kbps || ' kbps' END,
    CASE WHEN density > 0 THEN round_even(density * 1000, 0)::bigint || ' millibits a pixel' END, 'audio ' || audio_says, CASE WHEN subtitles_say <> '' THEN 'subtitles ' || subtitles_say END) AS caption FROM lines"""


@query("result_captions", o.planning(S, _container_sql(S)) + CAPTION_SQL)
def _(spark, d):
    return detail.details(plan(spark, d, S, subtitles=True), S).select("file_id", detail.caption().alias("caption"))


@query("provenance_tags", o.planning(S) + """ SELECT file_id, 'REELMILL_CODEC=h265;REELMILL_DATE=2024-01-31;REELMILL_MODE=' || mode || ';REELMILL_QUALITY=169' || CASE WHEN target_kbps > 0 THEN ';REELMILL_TARGET_KBPS=' || target_kbps ELSE '' END || ';REELMILL_TIER=EXCELLENT;REELMILL_VERSION=0.2' AS tags FROM decided WHERE mode IS NOT NULL""")
def _(spark, d):
    entries = F.array_sort(F.transform(F.map_entries(detail.tags(S, F.lit("2024-01-31").cast("date"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return plan(spark, d).where("mode is not null").select("file_id", F.array_join(entries, ";").alias("tags"))


SUBS = replace(S, sub_langs=("eng", "fre"), sub_kinds=("normal", "forced"))


@query("subtitle_kept", o.planning(S) + " SELECT file_id, count(*)::int AS kept, count(*) FILTER (forced)::int AS forced FROM subs WHERE language IN ('eng', 'fre') AND (forced OR NOT hoh) GROUP BY file_id")
def _(spark, d):
    kept = tracks.kept_subtitles(SUBS, F.col("subtitles"))
    rows = media.as_array(media.subtitle_tracks(spark, d), "subtitles").select("file_id", kept.alias("kept"))
    return rows.where(F.size("kept") > 0).select("file_id", F.size("kept").alias("kept"), F.size(F.filter("kept", lambda t: t["forced"])).alias("forced"))


@query("subtitle_kind_counts", o.planning(S) + ", k AS (SELECT language, unnest(list_filter([CASE WHEN forced THEN 'forced' END, CASE WHEN hoh THEN 'hoh' END, CASE WHEN NOT forced AND NOT hoh THEN 'normal' END], lambda x: x IS NOT NULL)) AS kind FROM subs) SELECT language, kind, count(*) AS tracks FROM k GROUP BY language, kind")
def _(spark, d):
    rows = media.subtitle_tracks(spark, d).select("language", F.explode(tracks.kinds(F.struct("forced", "hearing_impaired"))).alias("kind"))
    return rows.groupBy("language", "kind").agg(F.count("*").alias("tracks"))


@query("sidecar_names", o.planning(S) + """, t AS (SELECT file_id, language, row_number() OVER (PARTITION BY file_id ORDER BY idx, l_partkey, l_suppkey) AS nth, count(*) OVER (PARTITION BY file_id) AS n FROM subs WHERE codec IN ('subrip', 'ass'))
  SELECT file_id, 't' || name_id || CASE WHEN n > 1 THEN '.' || nth ELSE '' END || '.' || language || '.srt' AS sidecar FROM t JOIN files USING (file_id)""")
def _(spark, d):
    rows = media.files(spark, d).join(media.as_array(media.subtitle_tracks(spark, d), "subtitles"), "file_id")
    texts = F.filter("subtitles", lambda t: q.is_text_sub(t["codec"]))
    return tracks.sidecars(rows, stem(F.col("name")), texts).select("file_id", "sidecar")


# paths and gates -------------------------------------------------------------------------------------------------

FLAT = replace(S, output_mode="separate", output_dir="/out", output_flat=True)


@query("output_paths_flat_collisions", f"WITH {o.FILES.strip()} SELECT file_id, '/out/t' || name_id || '.mp4' AS out, row_number() OVER (PARTITION BY name_id ORDER BY path) = 1 AS writes FROM files")
def _(spark, d):
    rows = media.files(spark, d).withColumn("out", paths.output_path(FLAT, F.col("path"), F.lit("mp4")))
    return paths.collisions(rows, "out", "path").select("file_id", "out", "writes")


@query("output_paths_tree", f"WITH {o.FILES.strip()} SELECT file_id, '/out/d' || file_id || '/t' || name_id || '.mkv' AS out, '/lib/d' || file_id || '/t' || name_id || '.mkv' AS beside, '/lib/originals/d' || file_id AS archive FROM files")
def _(spark, d):
    tree, path = replace(FLAT, output_flat=False), F.col("path")
    return media.files(spark, d).select("file_id", paths.output_path(tree, path, F.lit("mkv")).alias("out"), paths.output_path(S, path, F.lit("mkv")).alias("beside"), paths.archive_folder(S, path).alias("archive"))


@query("size_gate", o.planning(S) + ", g AS (SELECT file_id, mode, size, trunc(size * (file_id % 11) / 10.0::double)::bigint AS made FROM decided WHERE mode IS NOT NULL) SELECT file_id, CASE WHEN mode = 'shrink' THEN made >= size * 0.75::double WHEN mode = 'transcode' THEN made > size * 1.005::double ELSE false END AS thrown FROM g")
def _(spark, d):
    made = (F.col("size") * (F.col("file_id") % 11) / 10.0).cast("long")
    return plan(spark, d).where("mode is not null").select("file_id", paths.size_gate(F.col("mode"), F.col("size"), made, S.min_saving_ratio).alias("thrown"))


@query("validity_gate", f"WITH {o.FILES.strip()} SELECT file_id, file_id % 13 <> 0 AND file_id % 17 <> 0 AND made > 0 AND NOT (duration > 1 AND made < duration * 0.95::double) AS valid FROM (SELECT *, duration * (file_id % 23) / 20.0::double AS made FROM files)")
def _(spark, d):
    key, made = F.col("file_id"), F.col("duration") * (F.col("file_id") % 23) / 20.0
    return media.files(spark, d).select("file_id", paths.validity(key % 13 != 0, F.when(key % 17 != 0, "hevc"), made, F.col("duration")).alias("valid"))


def _fate_sql() -> str:
    over, lost = "ext = 'mp4'", "file_id % 7 = 0"
    case = {
        "archive": f"CASE WHEN {over} THEN 'archived-first' ELSE 'archived' END",
        "delete": f"CASE WHEN {over} AND {lost} THEN 'archived-first' WHEN {lost} THEN 'archived' WHEN NOT {over} THEN 'deleted' ELSE 'overwritten' END",
        "keep": f"CASE WHEN {over} AND {lost} THEN 'archived-first' WHEN {over} THEN 'overwritten' ELSE 'kept' END",
    }
    return f"WITH {o.FILES.strip()} SELECT file_id, " + ", ".join(f"{v} AS on_{k}" for k, v in case.items()) + " FROM files"


@query("original_fate", _fate_sql())
def _(spark, d):
    out, lost = paths.output_path(S, F.col("path"), F.lit("mp4")), F.when(F.col("file_id") % 7 == 0, "image tracks").otherwise("")
    return media.files(spark, d).select("file_id", *[paths.fate(replace(S, source_action=a), out, F.col("path"), lost).alias(f"on_{a}") for a in ("archive", "delete", "keep")])


@query("preview_cache_keys", f"WITH {o.FILES.strip()} SELECT file_id, sha1(path || '|' || size || '|' || mtime || '|EXCELLENT|h265|')[1:10] AS cache_key, least(5.0::double, duration) AS seconds, greatest(0.0::double, least(0.5::double * duration, duration - 5)) AS starts FROM files")
def _(spark, d):
    window = detail.preview(F.col("duration"))
    return media.files(spark, d).select("file_id", detail.cache_key(S, F.col("path"), F.col("size"), F.col("mtime")).alias("cache_key"), window["seconds"].alias("seconds"), window["starts"].alias("starts"))


def _human(base: str, digits: int) -> str:
    power = lambda k: f"{base}::double ** {k}"
    cases = " ".join(f"WHEN size < {power(k + 1)} THEN {{{k}}}" for k in range(4)) + " ELSE {4} END"
    amount = "CASE " + cases.format(*[f"round_even(size / ({power(k)}), {digits})" for k in range(5)])
    return amount + f" AS amount_{base}, CASE " + cases.format("'B'", "'KB'", "'MB'", "'GB'", "'TB'") + f" AS unit_{base}"


@query("human_sizes", f"WITH {o.FILES.strip()} SELECT file_id, {_human('1024', 1)}, {_human('1000', 2)} FROM files")
def _(spark, d):
    sizes = [(b, q.human(F.col("size"), b, n)) for b, n in ((1024, 1), (1000, 2))]
    return media.files(spark, d).select("file_id", *[c[f].alias(f"{f}_{b}") for b, c in sizes for f in ("amount", "unit")])


# reports ---------------------------------------------------------------------------------------------------------


@query("run_summary", f"WITH {o.RESULTS.strip()} SELECT run, count(*) AS total, count(*) FILTER (changed) AS changed, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (NOT changed AND outcome <> 'error') AS left_alone FROM judged GROUP BY run")
def _(spark, d):
    return report.tally(media.results(spark, d), "run")


@query("outcome_table", f"WITH {o.RESULTS.strip()} SELECT outcome, count(*) AS files, CASE outcome WHEN 'shrink' THEN 1 WHEN 'transcode' THEN 2 WHEN 'remux' THEN 3 WHEN 'skip-at-tier' THEN 4 WHEN 'error' THEN 12 END AS place FROM results GROUP BY outcome")
def _(spark, d):
    return report.by_outcome(media.results(spark, d))


@query("space_saved", f"WITH {o.RESULTS.strip()}, t AS (SELECT count(*) AS files, sum(src_bytes)::bigint AS before, sum(out_bytes)::bigint AS after FROM judged WHERE changed) SELECT *, before - after AS saved, CASE WHEN before > 0 THEN (before - after) / before::double * 100 ELSE 0.0::double END AS percent FROM t WHERE files > 0")
def _(spark, d):
    return report.space_saved(media.results(spark, d))


@query("report_notes", f"WITH {o.RESULTS.strip()} SELECT run, event_id, path, 0 AS nth, level, 'note ' || event_id AS message FROM results WHERE level IS NOT NULL")
def _(spark, d):
    return report.notes(media.results(spark, d), ["run", "event_id"])


@query("bucket_summary", f"WITH {o.RESULTS.strip()} SELECT run, bucket, count(*) AS files, sum(saved)::bigint AS saved FROM judged GROUP BY run, bucket")
def _(spark, d):
    rows = media.results(spark, d).withColumns({"bucket": report.bucket(), "saved": report.saved_bytes()})
    return rows.groupBy("run", "bucket").agg(F.count("*").alias("files"), F.sum("saved").alias("saved"))


# time ------------------------------------------------------------------------------------------------------------


@query("work_seconds", o.planning(S) + f" SELECT file_id, {o.work()} AS seconds FROM decided")
def _(spark, d):
    return plan(spark, d).select("file_id", predict.work_seconds(F.lit(False)).alias("seconds"))


@query("work_totals", o.planning(S) + f", w AS (SELECT {o.work()} AS seconds FROM decided) SELECT round(avg(seconds), 3) AS mean, greatest(1, trunc(sum(seconds)))::bigint AS total, round(sum(seconds) FILTER (seconds >= 5), 3) AS heavy, count(*) FILTER (seconds < 5) AS light FROM w")
def _(spark, d):
    heavy = F.col("s") >= predict.HEAVY_SECONDS
    rows = plan(spark, d).select(predict.work_seconds(F.lit(False)).alias("s"))
    return rows.agg(F.round(F.avg("s"), 3).alias("mean"), F.greatest(F.lit(1), F.sum("s").cast("long")).alias("total"), F.round(F.sum(F.when(heavy, F.col("s"))), 3).alias("heavy"), F.count_if(~heavy).alias("light"))


TIMED = f"WITH {o.RESULTS.strip()}, timed AS (SELECT event_id, run, ts, CASE WHEN outcome IN ('shrink', 'transcode') THEN 20.0::double + event_id % 50 WHEN outcome = 'remux' THEN 10.0::double ELSE 0.1::double END AS predicted_s, ((event_id * 7) % 64) / 4.0::double AS real_s FROM results)"


def _timed(spark, d: str) -> DataFrame:
    seconds = F.when(F.col("outcome").isin("shrink", "transcode"), F.lit(20.0) + F.col("event_id") % 50).when(F.col("outcome") == "remux", 10.0).otherwise(0.1)
    return media.results(spark, d).select("event_id", "run", "ts", seconds.alias("predicted_s"), ((F.col("event_id") * 7) % 64 / 4.0).alias("real_s"))


@query("eta_trace", TIMED + """, sums AS (SELECT *, predicted_s >= 5 AS heavy FROM timed), r AS (SELECT event_id, run,
  sum(CASE WHEN heavy THEN predicted_s ELSE 0 END) OVER u AS hp, sum(CASE WHEN heavy THEN real_s ELSE 0 END) OVER u AS hr, sum(CASE WHEN heavy THEN 0 ELSE real_s END) OVER u AS lr, sum((NOT heavy)::int) OVER u AS ld,
  sum(CASE WHEN heavy THEN predicted_s ELSE 0 END) OVER w AS ha, sum((NOT heavy)::int) OVER w AS la FROM sums
  WINDOW u AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY run))
  SELECT event_id, run, round(greatest(0.0::double, (ha - hp) * greatest(0.2::double, least(5.0::double, CASE WHEN hp > 30 THEN hr / hp ELSE 1 END)) + (la - ld) * CASE WHEN ld > 20 THEN lr / ld ELSE 0.1::double END), 6) AS eta FROM r""")
def _(spark, d):
    return progress.trace(_timed(spark, d), "run", ["ts", "event_id"], "predicted_s", "real_s").select("event_id", "run", F.round("eta", 6).alias("eta"))


@query("result_gaps", TIMED + " SELECT event_id, run, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id), ts), 0) AS gap_us FROM timed")
def _(spark, d):
    return progress.gaps(_timed(spark, d), "run", ["ts", "event_id"], "ts").select("event_id", "run", "gap_us")


SHOWN = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS n FROM (
    SELECT 'user' || user_id AS label, event_id AS seq, event_id / 4.0::double AS at_s, CASE WHEN event_id % 9 <> 0 THEN event_id % 200 / 2000.0::double END AS fraction FROM events)),
  w AS (SELECT label, seq, at_s, fraction, n, true AS shows, at_s AS last, fraction AS seen FROM e WHERE n = 1
    UNION ALL SELECT label, seq, at_s, fraction, n, shows, CASE WHEN shows THEN at_s ELSE last END, CASE WHEN shows THEN fraction ELSE seen END FROM (
      SELECT e.*, w.last, w.seen, e.fraction IS NULL OR w.seen IS NULL OR abs(e.fraction - w.seen) >= 0.01::double OR e.at_s - w.last >= 1.5::double AS shows FROM w JOIN e ON e.label = w.label AND e.n = w.n + 1))
  SELECT label, seq, at_s, fraction FROM w WHERE shows"""


def _reports(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("label"), F.col("event_id").alias("seq"),
        (F.col("event_id") / 4.0).alias("at_s"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 200 / 2000.0).alias("fraction"),
    )


@query("progress_shown", SHOWN)
def _(spark, d):
    return progress.shown(_reports(media.table(spark, d, "events")))


@query("queue_chunks", f"WITH {o.FILES.strip()}, q AS (SELECT file_id, row_number() OVER (ORDER BY path) AS nth FROM files) SELECT file_id, nth::int AS nth, ((nth - 1) // 2000)::int AS chunk FROM q WHERE nth <= 50000")
def _(spark, d):
    return progress.chunks(media.files(spark, d).select("file_id", "path"), "path").select("file_id", "nth", "chunk")


@query("newest_generation", f"WITH {o.RESULTS.strip()} SELECT event_id, run FROM results WHERE run = (SELECT max(run) FROM results)")
def _(spark, d):
    return history.newest_generation(media.results(spark, d).select("event_id", "run"), "run")


# probe documents -------------------------------------------------------------------------------------------------


@query("probe_normalised", o.planning(S) + " SELECT file_id, vcodec, pixels::bigint AS pixels, fps, bit_rate, container_bit_rate, duration, n_audio::int AS n_audio, max_channels::int AS max_channels, n_subs::int AS n_subs, n_images::int AS n_images FROM media")
def _(spark, d):
    rows = probe.normalised(_documents(media.library(spark, d, subtitles=True)).select("file_id", "document"))
    return rows.select(
        "file_id", "vcodec", "pixels", "fps", "bit_rate", "container_bit_rate", "duration", F.size("audio").alias("n_audio"), q.max_channels(F.col("audio")).alias("max_channels"),
        F.size("subtitles").alias("n_subs"), F.size(F.filter("subtitles", lambda t: ~t["is_text"])).alias("n_images"),
    )


def _documents(rows: DataFrame) -> DataFrame:
    """``rows`` with a probe document of each, all scalars as text."""
    text = lambda c: c.cast("string")
    rate = F.when(F.abs(F.col("fps") - 24000 / 1001) < 1e-9, "24000/1001").otherwise(F.concat(text(F.col("fps").cast("int")), F.lit("/1")))
    none = F.lit(None).cast("string")
    stream = lambda kind, codec, **has: F.struct(*[has.get(n, F.lit(kind) if n == "codec_type" else codec if n == "codec_name" else none).alias(n) for n in ("codec_type", "codec_name", "width", "height", "avg_frame_rate", "bit_rate", "channels")])
    video = stream("video", F.col("vcodec"), width=text(F.col("width")), height=text(F.col("height")), avg_frame_rate=rate, bit_rate=text(F.col("bit_rate")))
    audio = F.transform("audio", lambda a: stream("audio", a["codec"], channels=text(a["channels"])))
    subs = F.transform("subtitles", lambda t: stream("subtitle", t["codec"]))
    form = F.struct(text(F.col("container_bit_rate")).alias("bit_rate"), text(F.col("duration")).alias("duration"))
    return rows.withColumn("document", F.to_json(F.struct(F.concat(F.array(video), audio, subs).alias("streams"), form.alias("format"))))


# streams ---------------------------------------------------------------------------------------------------------


def _event_files(spark, d: str) -> DataFrame:
    """The event table as files of a folder that a stream reads."""
    name = f"{d}/events.parquet"
    found = spark.read.parquet(name)
    schema = StructType.fromJson(found.schema.jsonValue())
    one_file = all(f.endswith("/events.parquet") for f in found.inputFiles())
    return live.stream(spark, d, schema, only="events.parquet") if one_file else live.stream(spark, name, schema)


def _streamed(spark, d: str) -> DataFrame:
    """The results of the events as a stream."""
    raw = _event_files(spark, d)
    outcome = F.when(F.col("event_type") == "purchase", "shrink").when(F.col("event_type") == "click", "transcode").when(F.col("event_type") == "view", "remux").when(F.col("event_type") == "signup", "skip-at-tier").otherwise("error")
    src = F.floor(F.col("value") * 1e6).cast("long")
    return raw.select("event_id", F.col("user_id").alias("run"), outcome.alias("outcome"), src.alias("src_bytes"), F.floor(src * (F.col("event_id") % 10 + 1) / 10.0).cast("long").alias("out_bytes"))


@query("stream_run_summary", f"WITH {o.RESULTS.strip()} SELECT outcome, count(*) AS files, sum(saved)::bigint AS saved FROM judged GROUP BY outcome")
def _(spark, d):
    return live.newest(live.drained(live.running_summary(_streamed(spark, d)), "complete", tables.place(spark, "stream")))


@query("stream_progress", SHOWN)
def _(spark, d):
    live.with_rocks(spark)
    rows = live.drained(live.throttled(_reports(_event_files(spark, d))), "append", tables.place(spark, "stream"))
    return rows.drop("batch")


@query("stream_eta", TIMED + """ SELECT run, done, spent_heavy, spent_light, CASE WHEN planned > 30 THEN least(5.0::double, greatest(0.2::double, spent_heavy / planned)) ELSE 1.0::double END AS rate, CASE WHEN n_light > 20 THEN spent_light / n_light ELSE 0.1::double END AS light_rate
  FROM (SELECT run, count(*) AS done, coalesce(sum(real_s) FILTER (predicted_s >= 5), 0.0::double) AS spent_heavy, coalesce(sum(real_s) FILTER (predicted_s < 5), 0.0::double) AS spent_light, coalesce(sum(predicted_s) FILTER (predicted_s >= 5), 0.0::double) AS planned, count(*) FILTER (predicted_s < 5) AS n_light FROM timed GROUP BY run)""")
def _(spark, d):
    seconds = F.when(F.col("outcome").isin("shrink", "transcode"), F.lit(20.0) + F.col("event_id") % 50).when(F.col("outcome") == "remux", 10.0).otherwise(0.1)
    timed = _streamed(spark, d).select("run", seconds.alias("predicted_s"), ((F.col("event_id") * 7) % 64 / 4.0).alias("real_s"))
    return live.newest(live.drained(live.running_eta(timed), "update", tables.place(spark, "stream")), "run")


# encoding --------------------------------------------------------------------------------------------------------

DEEP = "CASE WHEN file_id % 5 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END"


def _video_sql(s: Settings, hardware: str | None) -> str:
    profile = f"CASE WHEN contains({DEEP}, '10') THEN 'main10' ELSE 'main' END"
    soft = lambda crf, preset: f"'-c:v libx265 -crf {crf} -preset {preset} -maxrate ' || target_kbps || 'k -bufsize ' || target_kbps || 'k -profile:v ' || {profile} || ' -tag:v hvc1'"
    if s.codec == "h264":
        soft = lambda crf, preset: f"'-c:v libx264 -crf {int(crf) - (2 if preset == 'slow' else 1)} -preset {preset} -maxrate ' || target_kbps || 'k -bufsize ' || target_kbps || 'k -profile:v high -pix_fmt yuv420p'"
    case = f"CASE mode WHEN 'transcode' THEN {soft(20, 'slow')} ELSE {soft(21, 'medium')} END"
    if hardware == "hevc_videotoolbox":
        case = f"CASE WHEN file_id % 10 = 0 THEN {case} ELSE '-c:v hevc_videotoolbox -b:v ' || target_kbps || 'k -profile:v ' || {profile} || ' -tag:v hvc1 -bf 2 -fps_mode cfr' END"
    if hardware == "h264_nvenc":
        case = f"CASE WHEN file_id % 10 = 0 THEN {case} ELSE '-c:v h264_nvenc -b:v ' || target_kbps || 'k -maxrate ' || target_kbps || 'k -preset p5 -profile:v high -pix_fmt yuv420p' END"
    if hardware in ("hevc_qsv", "h264_amf"):
        ends = f"' || {profile} || ' -tag:v hvc1'" if hardware == "hevc_qsv" else "high -pix_fmt yuv420p'"
        case = f"CASE WHEN file_id % 10 = 0 THEN {case} ELSE '-c:v {hardware} -b:v ' || target_kbps || 'k -maxrate ' || target_kbps || 'k -profile:v {ends} END"
    return f"CASE WHEN mode = 'remux' THEN CASE WHEN vcodec = 'hevc' THEN '-c:v copy -tag:v hvc1' ELSE '-c:v copy' END ELSE {case} END"


ENCODERS = {"software": (S, None), "apple": (S, "hevc_videotoolbox"), "nvidia": (replace(S, codec="h264"), "h264_nvenc"), "intel": (S, "hevc_qsv"), "amd": (replace(S, codec="h264"), "h264_amf")}


def _pixels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pix_fmt", F.when(F.col("file_id") % 5 == 0, "yuv420p10le").otherwise("yuv420p"))


@query("video_arguments_rows", o.planning(S) + " SELECT file_id, " + ", ".join(f"{_video_sql(*v)} AS {k}" for k, v in ENCODERS.items()) + " FROM decided WHERE mode IS NOT NULL")
def _(spark, d):
    rows = _pixels(plan(spark, d).where("mode is not null"))
    return rows.select("file_id", *[F.array_join(execute.video_arguments(s, h, F.col("file_id") % 10 == 0), " ").alias(k) for k, (s, h) in ENCODERS.items()])


@query("attempt_rows", o.planning(S, _container_sql(FORCED)) + """, t AS (SELECT file_id, string_agg('-map 0:' || idx, ' ' ORDER BY idx, l_partkey, l_suppkey) AS maps FROM subs WHERE codec IN ('subrip', 'ass') GROUP BY file_id),
  c AS (SELECT d.file_id, maps, container, '-c:a ' || CASE WHEN container = 'mkv' OR (c.n_audio > 0 AND c.n_foreign = 0) THEN 'copy' ELSE 'aac -b:a ' || CASE WHEN c.max_channels > 2 THEN '448k' ELSE '256k' END END AS audio, """ + _video_sql(S, None).replace("file_id", "d.file_id") + """ AS video
    FROM decided d JOIN (SELECT file_id, container, n_audio, n_foreign, max_channels FROM contained) c USING (file_id) LEFT JOIN t USING (file_id) WHERE mode IS NOT NULL)
  SELECT file_id, '-map 0:v:0 -map 0:a? ' || CASE WHEN container = 'mkv' THEN '-map 0:s? ' || video || ' ' || audio || ' -c:s copy' WHEN maps IS NOT NULL THEN maps || ' ' || video || ' ' || audio || ' -c:s mov_text -movflags +faststart+use_metadata_tags' ELSE video || ' ' || audio || ' -movflags +faststart+use_metadata_tags' END AS first,
    CASE WHEN container <> 'mkv' AND maps IS NOT NULL THEN 2 ELSE 1 END AS attempts FROM c""")
def _(spark, d):
    rows = _pixels(plan(spark, d, S, subtitles=True).where("mode is not null"))
    rows = rows.withColumn("c", tracks.container(FORCED, F.col("ext"), F.col("audio"), F.col("subtitles"))).select("*", "c.container").drop("c")
    subs, none = F.col("subtitles"), F.array().cast("array<string>")
    found = execute.attempts(F.col("container"), execute.video_arguments(S, None, F.lit(False)), execute.audio_arguments(FORCED, F.col("container"), F.col("audio")), subs, subs, none)
    return rows.select("file_id", found.alias("a")).select("file_id", F.array_join(F.col("a")[0], " ").alias("first"), F.size("a").alias("attempts"))


@query("skip_existing", o.planning(S) + ", e AS (SELECT DISTINCT '/out/t' || name_id || '.mp4' AS there FROM files WHERE file_id % 3 = 0) SELECT file_id, CASE WHEN there IS NULL THEN mode END AS mode, CASE WHEN mode IS NOT NULL AND there IS NOT NULL THEN 'skip-existing' ELSE outcome END AS outcome FROM (SELECT *, '/out/t' || name_id || '.mp4' AS out FROM decided) LEFT JOIN e ON out = there")
def _(spark, d):
    rows = plan(spark, d).withColumn("out", paths.output_path(FLAT, F.col("path"), F.lit("mp4")))
    return paths.existing(rows, rows.where("file_id % 3 = 0").select(F.col("out").alias("path")), "out").select("file_id", "mode", "outcome")


@query("results_in_queue", f"WITH {o.FILES.strip()} SELECT file_id FROM files WHERE name IN (SELECT name FROM files WHERE file_id % 4 = 0)")
def _(spark, d):
    rows = media.files(spark, d)
    return history.by_name(rows, rows.where("file_id % 4 = 0")).select("file_id")


@query("scan_order", f"WITH {o.FILES.strip()} SELECT file_id, row_number() OVER (ORDER BY path) AS seq FROM files")
def _(spark, d):
    return plans.in_scan_order(media.files(spark, d).select("file_id", "path")).select("file_id", "seq")


@query("mean_work", o.planning(S) + f" SELECT round(avg({o.work()}), 6) AS mean FROM decided")
def _(spark, d):
    return plans.mean_work(plan(spark, d)).select(F.round("mean", 6).alias("mean"))


@query("free_until_success", f"WITH {o.FILES.strip()} SELECT file_id, NOT coalesce(bool_or(file_id % 3 <> 0) OVER (PARTITION BY name_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS writes FROM files")
def _(spark, d):
    rows = media.files(spark, d).withColumns({"out": paths.output_path(FLAT, F.col("path"), F.lit("mp4")), "worked": F.col("file_id") % 3 != 0})
    return paths.collisions(rows, "out", "path", "worked").select("file_id", "writes")


__all__ = ["ORACLE_SQL", "QUERIES"]
