"""Encodes into a shared stage, and their placement as one commit."""

import os
import sys
from functools import partial

import pytest
from pyspark.sql import functions as F

from reelmill.operators import execute, history, placement, report, volumes
from reelmill.settings import Settings

JOBS = "path string, out_path string, attempts array<array<string>>"


def test_errors_are_rows_and_the_second_attempt_counts(spark, tmp_path):
    jobs = spark.createDataFrame([("/a.mkv", str(tmp_path / "a.mp4"), [["-c:s", "mov_text"], ["-sn"]])], JOBS)

    def second(command, to, say):
        if "-sn" not in command:
            return "subtitles do not fit"
        with open(to, "wb") as f:
            f.write(b"12345")
        return ""

    row = execute.executed(jobs, str(tmp_path / "stage"), second).first()
    assert row.ok and row.out_bytes == 5 and row.attempt == 1 and os.path.getsize(row.staged) == 5 and not os.path.exists(row.out_path)
    assert execute.executed(jobs, str(tmp_path / "stage"), lambda c, t, s: "broken").first().error == "broken"


def test_a_stopped_run_drops_its_jobs(spark, tmp_path):
    stop, stage = tmp_path / "stop", str(tmp_path / "stage")
    jobs = spark.createDataFrame([(f"/{i}.mkv", str(tmp_path / f"{i}.mp4"), [["-c", "copy"]]) for i in range(3)], JOBS).coalesce(1)

    def first_stops(command, out, say):
        with open(out, "wb") as f:
            f.write(b"1")
        stop.touch()
        return ""

    assert [r.ok for r in execute.executed(jobs, stage, first_stops, stop=str(stop)).collect()] == [True]
    abort = tmp_path / "abort"
    running = partial(execute.tool, abort=str(abort))
    assert running([sys.executable, "-c", f"open({str(tmp_path / 'o')!r}, 'w')"], str(tmp_path / "o")) == ""
    assert running([sys.executable, "-c", "import sys; sys.exit('one\\ntwo\\nthree')"], str(tmp_path / "p")) == "two / three"
    abort.touch()
    assert running([sys.executable, "-c", "import time; time.sleep(60)"], str(tmp_path / "p")) == execute.ABORTED
    assert execute.executed(jobs, stage, lambda c, o, s: execute.ABORTED).collect() == []


def test_lines_come_while_an_encode_runs(spark, tmp_path):
    """A stand-in encoder prints three lines and waits for their file before it ends: they are there before its result."""
    folder = tmp_path / "progress"
    code = "import os, sys, time\nfor i in range(3): print(f'out_time_ms={i}000000', flush=True)\n" f"while not os.path.isdir({str(folder)!r}) or not os.listdir({str(folder)!r}): time.sleep(0.05)\nopen(sys.argv[-1], 'w').write('x')"

    def encode(command, out, say):
        return execute.tool([sys.executable, "-c", code, out], out, say)

    jobs = spark.createDataFrame([("/a.mkv", str(tmp_path / "a.mp4"), [["-c", "copy"]])], JOBS)
    assert execute.executed(jobs, str(tmp_path / "stage"), encode, progress=str(folder)).first().ok
    told = spark.read.schema(execute.REPORT).json(str(folder)).orderBy("seq").collect()
    assert [(r.label, r.seq, r.line) for r in told] == [("/a.mkv", i, f"out_time_ms={i}000000") for i in range(3)]


def test_copies_go_on_where_they_ended(tmp_path):
    source, part = tmp_path / "a", tmp_path / "b" / "part"
    source.write_bytes(bytes(range(250)) * 4)
    assert placement.copied(str(source), str(part), 100) == 10 and part.read_bytes() == source.read_bytes()
    part.write_bytes(source.read_bytes()[:430])
    assert placement.copied(str(source), str(part), 100) == 6 and part.read_bytes() == source.read_bytes()
    assert placement.copied(str(source), str(part), 100) == 0
    source.write_bytes(b"")
    assert placement.copied(str(source), str(tmp_path / "none"), 100) == 0 and (tmp_path / "none").read_bytes() == b""
    source.write_bytes(b"moved")
    placement.carried(str(source), str(tmp_path / "b" / "c"), same=lambda a, b: False)
    assert (tmp_path / "b" / "c").read_bytes() == b"moved" and not source.exists() and sorted(os.listdir(tmp_path / "b")) == ["c", "part"]


@pytest.fixture
def films(tmp_path):
    """Originals a to e with their staged outputs, and what is to be done with each; f has a ledger line alone."""
    rows = []
    for name, fate, own in (("a", "archived", False), ("b", "deleted", False), ("c", "kept", False), ("d", "overwritten", True), ("e", "archived-first", True)):
        path, staged = tmp_path / f"{name}.mkv", tmp_path / "stage" / f"{name}.new"
        path.write_text(f"old {name}")
        staged.parent.mkdir(exist_ok=True)
        staged.write_text(f"new {name}")
        rows.append((str(path), str(staged), str(path if own else tmp_path / "out" / f"{name}.mp4"), fate, str(tmp_path / "archive"), f"sig\t{path}\t5\t7"))
    return [*rows, (str(tmp_path / "f.mkv"), None, None, "kept", None, "sig\t/f\t1\t2")]


def state(folder):
    return {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n)).read() for at, _, names in os.walk(folder) for n in names if n.endswith((".mkv", ".mp4"))}


PLACED = {"c.mkv": "old c", "d.mkv": "new d", "e.mkv": "new e", "out/a.mp4": "new a", "out/b.mp4": "new b", "out/c.mp4": "new c", "archive/a.mkv": "old a", "archive/e.mkv": "old e"}


def test_outputs_originals_and_ledger_in_one_commit(spark, tmp_path, films):
    journal, ledger = str(tmp_path / "journal"), str(tmp_path / "ledger")
    placement.place(spark.createDataFrame(films, placement.SCHEMA).repartition(3), journal, ledger)
    assert state(tmp_path) == PLACED and os.listdir(journal) == ["placed"] and os.listdir(tmp_path / "stage") == []
    assert {(r.fate, r.done, r.failed) for r in report.disposals(placement.placed(spark, journal)).collect()} == {(f, 2 if f == "kept" else 1, 0) for f in ("archived", "deleted", "kept", "overwritten", "archived-first")}
    assert history.ledger_lines(spark, ledger) == 6 and history.read_ledger(spark, ledger).where("size = 5").count() == 5


def test_a_task_that_fails_after_its_write_leaves_one_output_and_one_line(spark, tmp_path, films):
    """The first attempt has written all it would write; the job's next attempt commits alone."""
    journal, ledger = str(tmp_path / "journal"), str(tmp_path / "ledger")
    names = [c.split()[0] for c in placement.SCHEMA.split(", ")]
    lost = placement.PlacementWriter(names, journal, ledger)
    lost.write(iter(films))
    assert state(tmp_path)["a.mkv"] == "old a" and not os.path.exists(ledger)
    again = placement.PlacementWriter(names, journal, ledger)
    again.commit([again.write(iter(films))])
    assert state(tmp_path) == PLACED and history.ledger_lines(spark, ledger) == 6
    assert placement.recovered(journal) == 0 and os.listdir(journal) == ["placed"]


@pytest.mark.parametrize("steps", range(7))
def test_a_lost_driver_is_recovered(spark, tmp_path, films, steps, monkeypatch):
    """The driver is lost after any number of settled files; the same journal, applied again, ends in the same state."""
    journal, ledger = str(tmp_path / "journal"), str(tmp_path / "ledger")
    writer = placement.PlacementWriter([c.split()[0] for c in placement.SCHEMA.split(", ")], journal, ledger)
    messages, done, settled = [writer.write(iter(films[:3])), writer.write(iter(films[3:]))], [], placement.settled

    def one_more(r):
        if len(done) == steps:
            raise RuntimeError("lost")
        settled(r)
        done.append(r)

    monkeypatch.setattr(placement, "settled", one_more)
    if steps < 6:
        with pytest.raises(RuntimeError):
            writer.commit(messages)
    else:
        writer.commit(messages)
    monkeypatch.setattr(placement, "settled", settled)
    assert placement.recovered(journal) == (steps < 6) and state(tmp_path) == PLACED
    assert history.ledger_lines(spark, ledger) == 6 and os.listdir(journal) == ["placed"]


def test_a_file_that_cannot_be_placed_is_told_and_not_recorded(spark, tmp_path, films):
    journal, ledger = str(tmp_path / "journal"), str(tmp_path / "ledger")
    (tmp_path / "out" / "a.mp4").mkdir(parents=True)  # in the way
    placement.place(spark.createDataFrame(films, placement.SCHEMA), journal, ledger)
    assert [r.path for r in placement.placed(spark, journal).where("error != ''").collect()] == [films[0][0]]
    assert history.ledger_lines(spark, ledger) == 5 and state(tmp_path)["a.mkv"] == "old a" and state(tmp_path)["out/b.mp4"] == "new b"


def test_an_aborted_commit_changes_nothing(tmp_path, films):
    writer = placement.PlacementWriter([c.split()[0] for c in placement.SCHEMA.split(", ")], str(tmp_path / "journal"), str(tmp_path / "ledger"))
    before = state(tmp_path)
    writer.abort([writer.write(iter(films)), None])
    assert state(tmp_path) == before and os.listdir(tmp_path / "journal") == [] and not (tmp_path / "ledger").exists()


def test_each_host_tries_its_encoders_once(spark, tmp_path):
    """Three tasks on two hosts; a family is listed and broken on one of them."""
    tries = tmp_path / "tries"
    tries.mkdir()

    def host():
        from pyspark import BarrierTaskContext

        return "h0" if BarrierTaskContext.get().partitionId() < 2 else "h1"

    def works(name):
        (tries / f"{host()}-{name}-{os.urandom(4).hex()}").touch()
        return not (host() == "h0" and name == "hevc_nvenc")

    found = execute.encoders_of_hosts(spark, "h265", lambda: "V hevc_nvenc V hevc_qsv V h264_amf", works, 3, host)
    rows = found.collect()
    assert len(rows) == 8 and {(r.host, r.encoder) for r in rows if r.works} == {("h0", "hevc_qsv"), ("h1", "hevc_nvenc"), ("h1", "hevc_qsv")}
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(tries)) == ["h0-hevc_nvenc", "h0-hevc_qsv", "h1-hevc_nvenc", "h1-hevc_qsv"]
    again = spark.createDataFrame(rows, found.schema)
    pick = lambda s: {r.host: r.encoder for r in execute.chosen_encoders(again, s).collect()}
    assert pick(Settings()) == pick(Settings(encoder="hardware")) == {"h0": "hevc_qsv", "h1": "hevc_nvenc"} and pick(Settings(encoder="software")) == {"h0": None, "h1": None}


def test_a_long_ledger_is_read_by_signature_and_not_shuffled(spark, tmp_path):
    s, other = Settings(), Settings(tier="GOOD")
    files = spark.range(200).select(F.concat(F.lit("/f"), "id").alias("path"), F.col("id").alias("size"), (F.col("id") + 7).alias("mtime"))
    ledger = history.keyed(files.where("size % 2 = 0"), s).unionByName(history.keyed(files, other)).unionByName(history.keyed(files.where("size < 9"), other))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    table = history.stored_ledger(ledger, "ledger_of_test", str(tmp_path / "ledger"), 4)
    held = history.held_files(files, table, s.signature())
    assert held.count() == 100 and history.held_files(files, table, s.signature(), "left_anti").count() == 100 and table.count() == 300
    plan = held._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "PartitionFilters: [isnotnull(signature" in scan and "Bucketed: true" in scan
    assert plan.count("Exchange hashpartitioning") == 1  # the library's side alone
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE ledger_of_test")


def test_a_cache_of_repeated_and_outdated_probes_adds_no_row(spark):
    scan = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2), ("/c", 3, 3), ("/d", None, None)], "path string, size long, mtime long")
    cache = spark.createDataFrame([("/a", 1, 1, 5.0, 1), ("/a", 1, 1, 4.0, 2), ("/b", 9, 2, 7.0, 3), ("/b", 2, 1, 8.0, 4), ("/d", None, None, 3.0, 1), ("/e", 1, 1, 1.0, 1)], "path string, size long, mtime long, seconds double, at long")
    got = history.filled(scan, cache, "seconds", F.lit(50.0), "at")
    assert sorted(map(tuple, got.select("path", "seconds").collect())) == [("/a", 4.0), ("/b", 50.0), ("/c", 50.0), ("/d", 3.0)] and got.columns == ["path", "size", "mtime", "seconds"]
    assert sorted(map(tuple, history.filled(scan.select("path"), cache, "seconds", F.lit(50.0)).collect())) == [("/a", 5.0), ("/b", 8.0), ("/c", 50.0), ("/d", 3.0)]


def test_a_stop_marker(tmp_path):
    stopped = volumes.marker(str(tmp_path / "stop"))
    assert not stopped() and not volumes.marker("")()
    (tmp_path / "stop").touch()
    assert stopped()
