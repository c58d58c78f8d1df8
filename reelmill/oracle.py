"""DuckDB SQL for the planning queries, built from the same settings as the plans."""

from __future__ import annotations

from reelmill.settings import Settings

#: Fixed values, written out here and not taken from the engine, so that a wrong constant there shows.
H264, MODERN = ("h264", "avc"), ("hevc", "av1", "vp9")
LEGACY = ("mpeg2video", "mpeg4", "msmpeg4v1", "msmpeg4v2", "msmpeg4v3", "msmpeg4", "vc1", "wmv1", "wmv2", "wmv3", "flv1", "rv30", "rv40")
LOSSLESS, HIGH, MEDIUM = ("truehd", "mlp", "flac", "alac", "pcm_s16le", "pcm_s24le", "pcm_bluray"), ("dts", "dca"), ("ac3", "eac3")
MP4_AUDIO, MP4_EXTS = ("aac", "ac3", "eac3", "mp3", "alac", "mp4als"), ("mp4", "m4v", "mov")
TEXT_SUBS = ("subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text")
VIDEO_EXTS = ("mkv", "mp4", "mov", "avi", "webm", "m4v", "ts", "wmv", "flv")
MBPS = {"OK": 6.0, "GOOD": 8.0, "EXCELLENT": 10.5, "STELLAR": 13.0, "INSANE": 15.5}
#: How the test library is made from the order tables.
CODECS = ("h264",) * 6 + ("hevc", "av1", "vp9", "mpeg2video", "mpeg4", "prores")
SIZES = ((640, 360), (1280, 720), (1920, 1080), (2560, 1440), (3840, 2160), (7680, 4320))
AUDIO, SUBTITLES, LANGUAGES = ("aac", "ac3", "dts", "truehd", "opus", "flac"), ("subrip", "ass", "hdmv_pgs_subtitle", "dvd_subtitle"), ("eng", "fre", "spa", "und")
FPS = (24000 / 1001, 25.0, 30.0, 60.0, 0.0)


def density(s: Settings) -> float:
    """Bits a pixel and frame of the tier, or of the settings' own where they have one."""
    return s.tier_bpp.get(s.tier) or MBPS[s.tier] * 1e6 / (1920 * 1080 * 30)


def real(x: float) -> str:
    return f"{x:.17e}"


def text(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pick(values, number: str, kind=None) -> str:
    items = ", ".join(real(v) if isinstance(v, float) else str(v) if isinstance(v, int) else f"'{v}'" for v in values)
    return f"([{items}])[(({number}) % {len(values)} + 1)::int]"


FILES = f"""
files AS (
  SELECT *, width * height AS pixels, '/lib/d' || file_id || '/t' || name_id || '.' || ext AS path, 't' || name_id || '.' || ext AS name,
    trunc(container_bit_rate / 8.0::double * duration)::bigint AS size
  FROM (SELECT o_orderkey AS file_id, o_custkey AS name_id, o_orderstatus, o_orderdate, {pick(VIDEO_EXTS, "o_custkey")} AS ext,
    {pick(CODECS, "7 * o_orderkey + o_custkey")} AS vcodec, {pick(tuple(w for w, _ in SIZES), "o_orderkey")}::bigint AS width,
    {pick(tuple(h for _, h in SIZES), "o_orderkey")}::bigint AS height, {pick(FPS, "o_orderkey")} AS fps,
    CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE trunc(60 * o_totalprice)::bigint END AS bit_rate, trunc(66 * o_totalprice)::bigint AS container_bit_rate,
    (60 + (37 * o_custkey + o_orderkey) % 7200)::double AS duration, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS own_work, epoch(o_orderdate)::bigint AS mtime
  FROM orders)
)"""

TRACKS = f"""
audio AS (
  SELECT l_orderkey AS file_id, l_linenumber AS idx, {pick(AUDIO, "l_partkey")} AS codec, {pick((2, 6, 8), "l_suppkey")} AS channels FROM lineitem WHERE l_returnflag = 'A'
), subs AS (
  SELECT l_orderkey AS file_id, l_linenumber AS idx, l_partkey, l_suppkey, {pick(SUBTITLES, "l_partkey")} AS codec, {pick(LANGUAGES, "l_linenumber")} AS language,
    l_discount >= 0.08::double AS forced, l_tax >= 0.07::double AS hoh FROM lineitem WHERE l_returnflag = 'N'
), a AS (
  SELECT file_id, count(*) AS n_audio, max(channels) AS max_channels, count(*) FILTER (codec NOT IN ({text(MP4_AUDIO)})) AS n_foreign,
    string_agg(DISTINCT upper(codec), ', ' ORDER BY upper(codec)) FILTER (codec NOT IN ({text(MP4_AUDIO)})) AS foreign_codecs,
    sum(greatest(1, channels) * CASE WHEN codec IN ({text(LOSSLESS)}) THEN 500000 WHEN codec IN ({text(HIGH)}) THEN 250000 WHEN codec IN ({text(MEDIUM)}) THEN 80000 ELSE 64000 END)::bigint AS guess
  FROM audio GROUP BY file_id
), s AS (
  SELECT file_id, count(*) AS n_subs, count(*) FILTER (codec NOT IN ({text(TEXT_SUBS)})) AS n_images,
    string_agg(DISTINCT codec, ', ' ORDER BY codec) FILTER (codec NOT IN ({text(TEXT_SUBS)})) AS image_codecs
  FROM subs GROUP BY file_id
), media AS (
  SELECT files.*, coalesce(n_audio, 0) AS n_audio, coalesce(max_channels, 0) AS max_channels, coalesce(n_foreign, 0) AS n_foreign, foreign_codecs, coalesce(guess, 0) AS guess,
    coalesce(n_subs, 0) AS n_subs, coalesce(n_images, 0) AS n_images, image_codecs
  FROM files LEFT JOIN a USING (file_id) LEFT JOIN s USING (file_id)
), rated AS (
  SELECT *, effective_bps / 1000.0::double AS source_kbps FROM (
    SELECT *, CASE WHEN bit_rate <> 0 THEN bit_rate WHEN container_bit_rate = 0 THEN 0 WHEN container_bit_rate - guess <= 0 THEN container_bit_rate
      ELSE container_bit_rate - guess END AS effective_bps FROM media)
)"""


def factor(s: Settings) -> str:
    hd, uhd, above = (real(x) for x in s.hevc)
    return f"CASE WHEN pixels <= 2073600 THEN {hd} WHEN pixels <= 8294400 THEN {uhd} ELSE {above} END" if s.codec == "h265" else real(1.0)


def raw_target(s: Settings) -> str:
    return f"greatest({real(float(s.floor_kbps))}, {real(density(s))} * pixels * CASE WHEN fps > 0 THEN fps ELSE 30.0::double END * ({factor(s)}) / 1000.0::double)"


def decided(s: Settings) -> str:
    t = raw_target(s)
    yes = lambda b: str(bool(b)).lower()
    return f"""
aimed AS (
  SELECT *, trunc({t})::bigint AS aim, trunc(CASE WHEN source_kbps > 0 THEN least({t}, source_kbps) ELSE {t} END)::bigint AS capped,
    CASE WHEN vcodec IN ({text(H264)}) THEN 'h264' WHEN vcodec IN ({text(MODERN)}) THEN 'modern' WHEN vcodec IN ({text(LEGACY)}) THEN 'legacy' ELSE 'other' END AS class,
    ext IN ({text(MP4_EXTS)}) AS mp4
  FROM rated
), ruled AS (
  SELECT *, CASE
    WHEN {yes(s.leave_non_mp4)} AND NOT mp4 THEN 'skip-non-mp4'
    WHEN own_work AND {yes(not s.allow_second_generation)} THEN 'skip-second-generation'
    WHEN class = 'h264' AND aim > 0 AND source_kbps > aim * {real(s.tolerance)} AND aim <= source_kbps * {real(s.min_saving_ratio)} THEN 'shrink'
    WHEN class IN ('h264', 'modern') AND {yes(s.remux_to_mp4)} AND NOT mp4 THEN 'remux'
    WHEN class = 'h264' AND source_kbps > 0 AND source_kbps < aim * {real(2.0 - s.tolerance)} THEN 'skip-under-tier'
    WHEN class = 'h264' THEN 'skip-at-tier'
    WHEN class = 'modern' THEN 'skip-modern'
    WHEN class = 'legacy' AND {yes(s.compat_transcode)} THEN 'transcode'
    WHEN class = 'legacy' THEN 'skip-incompatible'
    ELSE 'skip-codec' END AS ruling
  FROM aimed
), decided AS (
  SELECT *, CASE WHEN ruling IN ('shrink', 'transcode', 'remux') THEN ruling END AS mode, CASE WHEN ruling NOT IN ('shrink', 'transcode', 'remux') THEN ruling END AS outcome,
    CASE ruling WHEN 'shrink' THEN capped WHEN 'transcode' THEN CASE WHEN source_kbps > 0 THEN trunc(source_kbps * 0.85::double)::bigint ELSE {s.floor_kbps} END ELSE 0 END AS target_kbps
  FROM ruled
)"""


def predicted(s: Settings) -> str:
    rest = "greatest(0.0::double, size - bit_rate / 8.0::double * duration)"
    if s.audio_policy in ("aac", "ac3"):
        per = f"(CASE WHEN max_channels > 2 THEN {s.audio_kbps_multichannel} ELSE {s.audio_kbps_stereo} END)"
        rest = f"CASE WHEN n_audio > 0 THEN {per} * 1000.0::double / 8.0::double * duration * n_audio ELSE {rest} END"
    return f"""
sized AS (
  SELECT *, CASE WHEN mode IS NULL OR mode = 'remux' OR duration <= 0 OR target_kbps <= 0 OR source_kbps <= 0 THEN size
    WHEN bit_rate = 0 THEN trunc(least(size::double, size * least(1.0::double, target_kbps / source_kbps)))::bigint
    ELSE trunc(least(size::double, target_kbps * 1000.0::double / 8.0::double * duration + ({rest})))::bigint END AS predicted
  FROM decided
), planned AS (
  SELECT *, CASE WHEN mode = 'remux' THEN 0.0::double WHEN mode IS NULL THEN NULL WHEN size > 0 THEN greatest(0.0::double, 1.0::double - predicted / size::double)
    WHEN source_kbps > 0 THEN greatest(0.0::double, 1.0::double - target_kbps / source_kbps) END AS saving
  FROM sized
)"""


def work(picked: str = "false") -> str:
    px = f"CASE WHEN pixels > 0 THEN 2073600.0::double / pixels ELSE 1.0::double END"
    speed = f"(CASE WHEN {picked} THEN 0.82::double ELSE 6.0::double END * ({px}))"
    return f"CASE WHEN mode IN ('shrink', 'transcode') THEN CASE WHEN duration > 0 THEN duration / {speed} ELSE 1800.0::double / {speed} END WHEN mode = 'remux' THEN 10.0::double ELSE 0.1::double END"


RESULTS = """
results AS (
  SELECT event_id, ts, user_id AS run, '/lib/e' || event_id AS path,
    CASE event_type WHEN 'purchase' THEN 'shrink' WHEN 'click' THEN 'transcode' WHEN 'view' THEN 'remux' WHEN 'signup' THEN 'skip-at-tier' ELSE 'error' END AS outcome,
    floor(value * 1e6)::bigint AS src_bytes, floor(floor(value * 1e6)::bigint * (event_id % 10 + 1) / 10.0::double)::bigint AS out_bytes,
    CASE WHEN event_id % 7 = 0 THEN 'WARN' WHEN event_id % 5 = 0 THEN 'NOTE' END AS level
  FROM events
), judged AS (
  SELECT *, outcome IN ('shrink', 'transcode', 'remux') AS changed,
    CASE WHEN outcome = 'error' OR level = 'WARN' THEN 'fail' WHEN outcome IN ('shrink', 'transcode', 'remux') THEN 'ok' ELSE 'skip' END AS bucket,
    CASE WHEN outcome IN ('shrink', 'transcode', 'remux') THEN greatest(0, src_bytes - out_bytes) ELSE 0 END AS saved
  FROM results
)"""

NAMED = """
named AS (
  SELECT doc_id, regexp_replace(split_part(text, chr(10), 1)[1:40], '[/.]', ' ', 'g') || '.' || CASE lang WHEN 'en' THEN 'mkv' WHEN 'de' THEN 'avi' WHEN 'fr' THEN 'mp4' ELSE 'ts' END AS name,
    n_chars * 1000 AS size, CASE doc_id % 3 WHEN 0 THEN 'Reelmill shrink to h265' WHEN 1 THEN 'reelmill remux' ELSE text END AS comment FROM documents
)"""


def planning(s: Settings, *more: str) -> str:
    return "WITH " + ", ".join(x.strip() for x in (FILES, TRACKS, decided(s), predicted(s), *more))


__all__ = ["FILES", "NAMED", "RESULTS", "TRACKS", "decided", "planning", "predicted", "work"]
