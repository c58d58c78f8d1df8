"""Encoding: the order of attempts, the arguments of each, and a pluggable executor that never fails a task."""

from __future__ import annotations

import json
import os
import selectors
import socket
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.operators import placement, tracks, volumes
from reelmill.settings import Settings

RESULT = "path string, ok boolean, staged string, out_path string, out_bytes long, attempt int, error string"
REPORT = "label string, seq long, at_s double, line string"
#: Quality factor by codec and preset of software encoding, by what is done.
SOFTWARE = {"transcode": ({"h264": "18", "h265": "20"}, "slow"), "shrink": ({"h264": "20", "h265": "21"}, "medium")}
#: Hardware encoder families in the order in which they are tried.
FAMILIES = ("videotoolbox", "nvenc", "qsv", "amf")
#: What an encode says that was ended because the run was; its job gives no row.
ABORTED = "aborted"


def texts(*parts: str | Column) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def video_arguments(s: Settings, hardware: str | None, picked: Column) -> Column:
    """Arguments for the video of a decided file: a copy, rate-capped software encoding, or a hardware encoder at the target rate.

    Software is taken where no ``hardware`` encoder is named, where the settings say so, and for ``picked`` files.
    """
    rate = F.concat(F.col("target_kbps").cast("string"), F.lit("k"))
    deep = F.when(F.contains(F.coalesce("pix_fmt", F.lit("")), F.lit("10")), "main10").otherwise("main")
    hvc1, plain = ("-tag:v", "hvc1"), ("-pix_fmt", "yuv420p")
    still = F.when(F.lower(F.coalesce("vcodec", F.lit(""))) == "hevc", texts("-c:v", "copy", *hvc1)).otherwise(texts("-c:v", "copy"))

    def software(mode: str) -> Column:
        crf, preset = SOFTWARE[mode]
        library, ends = ("libx264", ("high", *plain)) if s.codec == "h264" else ("libx265", (deep, *hvc1))
        return texts("-c:v", library, "-crf", crf[s.codec], "-preset", preset, "-maxrate", rate, "-bufsize", rate, "-profile:v", *ends)

    by_mode = F.when(F.col("mode") == "transcode", software("transcode")).otherwise(software("shrink"))
    if hardware is not None and s.encoder != "software":
        newer = "hevc" in hardware
        profile, ends = (deep, hvc1) if newer else ("high", plain)
        start = ("-c:v", hardware, "-b:v", rate)
        chosen = {
            "videotoolbox": texts(*start, "-profile:v", profile, *ends, "-bf", "2", *(("-fps_mode", "cfr") if newer else ())),
            "nvenc": texts(*start, "-maxrate", rate, "-preset", "p5", "-profile:v", profile, *ends),
            "qsv": texts(*start, "-maxrate", rate, "-profile:v", profile, *ends),
            "amf": texts(*start, "-maxrate", rate, "-profile:v", profile, *ends),
        }.get(hardware.rsplit("_", 1)[-1], texts(*start, "-maxrate", rate, *ends))
        by_mode = F.when(picked, by_mode).otherwise(chosen)
    return F.when(F.col("mode") == "remux", still).otherwise(by_mode)


def audio_arguments(s: Settings, kind: Column, audio: Column) -> Column:
    """The codec of the audio plan, with its rate where it has one."""
    plan = tracks.audio_plan(s, kind, audio)
    codec = F.array(F.lit("-c:a"), plan["codec"])
    return F.when(plan["kbps"].isNull(), codec).otherwise(F.concat(codec, F.array(F.lit("-b:a"), F.concat(plan["kbps"].cast("string"), F.lit("k")))))


def attempts(kind: Column, video: Column, audio: Column, subtitles: Column, wanted: Column, tags: Column) -> Column:
    """Attempts in order, each all the arguments between input and output.

    Matroska copies all subtitles, or the ``wanted`` ones where some are not; MP4 embeds the wanted text tracks first
    and then goes without any.
    """
    maps = lambda kept: F.flatten(F.transform(kept, lambda t: F.array(F.lit("-map"), F.concat(F.lit("0:"), t["index"].cast("string")))))
    base, text = texts("-map", "0:v:0", "-map", "0:a?"), F.filter(wanted, lambda t: q.is_text_sub(t["codec"]))
    every = F.when(F.size(wanted) == F.size(subtitles), texts("-map", "0:s?")).otherwise(maps(wanted))
    mkv = F.concat(base, every, video, audio, texts("-c:s", "copy"), tags)
    ends = F.concat(tags, texts("-movflags", "+faststart+use_metadata_tags"))
    embed, none = F.concat(base, maps(text), video, audio, texts("-c:s", "mov_text"), ends), F.concat(base, video, audio, ends)
    return F.when(kind == "mkv", F.array(mkv)).when(F.size(text) > 0, F.array(embed, none)).otherwise(F.array(none))


def tool(command: list[str], out: str, say: Callable[[str], None] = lambda line: None, abort: str = "", every: float = 0.2) -> str:
    """Run the encoder; the last two lines of what it says where it fails.

    What it prints is passed on line by line as it comes. It is killed when the file ``abort`` is there.
    """
    ended, rest = volumes.marker(abort), b""
    with tempfile.TemporaryFile() as errors, selectors.DefaultSelector() as waits:
        with subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=errors) as running:
            waits.register(running.stdout, selectors.EVENT_READ)
            talks = True
            while talks or running.poll() is None:
                if ended():
                    running.kill()
                    return ABORTED
                if talks and waits.select(every):
                    data = os.read(running.stdout.fileno(), 1 << 16)
                    talks = bool(data)
                    *lines, rest = (rest + data).split(b"\n")
                    for line in lines:
                        say(line.decode(errors="replace"))
                elif not talks:
                    time.sleep(every)
        if running.returncode == 0 and os.path.exists(out):
            return ""
        errors.seek(0)
        return " / ".join(errors.read().decode(errors="replace").strip().splitlines()[-2:]) or "no output"


class Reports:
    """The lines of one running job as files of a shared folder, which a stream of schema ``REPORT`` reads; a file each ``every`` seconds at most."""

    def __init__(self, folder: str, label: str, every: float = 0.5):
        self.folder, self.label, self.every, self.seq, self.held, self.last = folder, label, every, 0, [], 0.0

    def say(self, line: str) -> None:
        self.held.append({"label": self.label, "seq": self.seq, "at_s": time.time(), "line": line})
        self.seq += 1
        if time.monotonic() - self.last >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held and self.folder:
            name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
            placement.written_whole(f"{self.folder}/{name}", "".join(f"{json.dumps(r)}\n" for r in self.held))
        self.held, self.last = [], time.monotonic()


def executed(jobs: DataFrame, stage: str, encode: Callable[[list[str], str, Callable[[str], None]], str] = tool, binary: str = "ffmpeg", stop: str = "", progress: str = "") -> DataFrame:
    """One result row for each job of (path, out_path, attempts array<array<string>>).

    The output of the first attempt that succeeds is the file ``staged`` in the folder ``stage``, which all executors
    share; ``placement.place`` puts it in its place. So a task that runs again, or twice at once, repeats work and
    changes nothing that others see. Errors are rows. While a job runs, what the encoder prints is told in the folder
    ``progress`` (``Reports``), all of it before the job's result. Once the file ``stop`` is there jobs that run are
    finished and the others give no row, as aborted ones.
    """
    fields = [f.split()[0] for f in RESULT.split(", ")]
    stopped = volumes.marker(stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(stage, exist_ok=True)
        for rows in batches:
            for r in rows.itertuples():
                if not stopped() and (done := one(r)):
                    yield pd.DataFrame([done], columns=fields)

    def one(job) -> tuple | None:
        error, told = "no attempts", Reports(progress, job.path)
        for k, a in enumerate(job.attempts):
            out = os.path.join(stage, f"{uuid.uuid4().hex}-{os.path.basename(job.out_path)}")
            try:
                error = encode([binary, "-y", "-i", job.path, *a, out], out, told.say)
                if error == ABORTED:
                    return None
                if not error:
                    return job.path, True, out, job.out_path, os.path.getsize(out), k, ""
            except OSError as e:
                error = str(e)
            finally:
                told.flush()
                if error and os.path.exists(out):
                    os.unlink(out)
        return job.path, False, None, job.out_path, 0, -1, error

    return jobs.select("path", "out_path", "attempts").mapInPandas(run, RESULT)


def encoders_of_hosts(spark: SparkSession, codec: str, listing: Callable[[], str], works: Callable[[str], bool], tasks: int, host: Callable[[], str] = socket.gethostname) -> DataFrame:
    """(host, encoder, listed, works) of every hardware family on every host: each host tries each listed family once.

    A barrier stage of ``tasks`` tasks (as many as the cluster runs at once, so that every host has one) first
    gathers the tasks' hosts; on each host the first task lists and tries for all.
    """
    stem = "hevc" if codec == "h265" else "h264"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            pass
        context = BarrierTaskContext.get()
        own = host()
        hosts = context.allGather(own)
        if hosts.index(own) == context.partitionId():
            listed = listing()
            names = [f"{stem}_{family}" for family in FAMILIES]
            yield pd.DataFrame([(own, n, n in listed, n in listed and bool(works(n)), k) for k, n in enumerate(names)], columns=["host", "encoder", "listed", "works", "nth"])

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "host string, encoder string, listed boolean, works boolean, nth int", barrier=True)


def chosen_encoders(found: DataFrame, s: Settings) -> DataFrame:
    """(host, encoder): the first family that works on each host; null for software, and where the settings ask for it."""
    first = F.min_by("encoder", F.when(F.col("works"), F.col("nth")))
    return found.groupBy("host").agg((F.lit(None).cast("string") if s.encoder == "software" else F.when(F.bool_or("works"), first)).alias("encoder"))
