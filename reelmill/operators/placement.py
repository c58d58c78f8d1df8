"""Outputs, originals and ledger lines of a run as one commit: a Spark sink that is all done or not begun."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a range of a copy; what is there of a part is whole ranges.
RANGE = 8 << 20
SCHEMA = "path string, staged string, out_path string, fate string, archive string, ledger string"


def part_name(source: str, target: str) -> str:
    """Where a copy grows: beside its target, named by what is copied, so that a second attempt finds the first one's ranges."""
    at = os.stat(source)
    mark = hashlib.sha1(f"{source}|{at.st_size}|{at.st_mtime_ns}".encode()).hexdigest()[:16]
    return os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{mark}.part")


def copied(source: str, part: str, size: int = RANGE) -> int:
    """Copy the ranges of ``source`` that ``part`` doesn't have yet; how many. A range half there is copied again."""
    os.makedirs(os.path.dirname(part), exist_ok=True)
    total, ranges = os.path.getsize(source), 0
    with open(source, "rb") as r, open(part, "r+b" if os.path.exists(part) else "w+b") as w:
        begin = min(os.path.getsize(part), total) // size * size
        for start in range(begin, total, size):
            r.seek(start)
            w.seek(start)
            w.write(r.read(size))
            w.flush()
            ranges += 1
        w.truncate(total)
        os.fsync(w.fileno())
    return ranges


def same_volume(source: str, folder: str) -> bool:
    os.makedirs(folder, exist_ok=True)
    return os.stat(source).st_dev == os.stat(folder).st_dev


def beside(source: str, target: str, same=same_volume) -> str:
    """A file on the target's volume with the source's bytes: the source itself, or a copy that can be resumed."""
    if same(source, os.path.dirname(target)):
        return source
    part = part_name(source, target)
    copied(source, part)
    return part


def carried(source: str, target: str, same=same_volume) -> None:
    """Move a file, by a copy where it changes its volume; the source goes last."""
    at = beside(source, target, same)
    os.replace(at, target)
    if at != source and os.path.exists(source):
        os.unlink(source)


def written_whole(path: str, text: str) -> None:
    """A file that is there with all its text or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.{uuid.uuid4().hex}.new", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


@dataclass
class Fragment(WriterCommitMessage):
    """What one task would do, as a file of the journal."""

    name: str


class Placement(DataSource):
    """Sink ``reelmill_placement`` with the options ``journal`` and ``ledger``: folders that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "reelmill_placement"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PlacementWriter([f.name for f in schema.fields], self.options["journal"], self.options["ledger"])


class PlacementWriter(DataSourceWriter):
    """Tasks bring outputs to the volume of their target and note in the journal what is to be done; the driver does it once.

    Nothing that others can see happens before all tasks have ended: a task that fails, runs twice or is lost leaves
    a fragment that no manifest names. The manifest is the commit; what follows can be repeated (``recovered``).
    """

    def __init__(self, names: list[str], journal: str, ledger: str):
        self.names, self.journal, self.ledger = names, journal, ledger

    def write(self, rows: Iterator) -> Fragment:
        name = uuid.uuid4().hex
        lines = []
        for row in rows:
            r = dict(zip(self.names, row))
            r["ready"] = beside(r["staged"], r["out_path"]) if r["staged"] else None
            lines.append(json.dumps(r))
        written_whole(f"{self.journal}/{name}.fragment", "".join(f"{line}\n" for line in lines))
        return Fragment(name)

    def commit(self, messages: list) -> None:
        manifest = f"{self.journal}/{uuid.uuid4().hex}.manifest"
        written_whole(manifest, json.dumps({"ledger": self.ledger, "fragments": [m.name for m in messages if m is not None]}))
        applied(manifest)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.journal}/{m.name}.fragment"):
                os.unlink(f"{self.journal}/{m.name}.fragment")


def settled(r: dict) -> None:
    """Put one output in its place and its original where its fate says. Each step is passed over where it was done before."""
    original, out, at = r["path"], r["out_path"], r["ready"]
    old = os.path.join(r["archive"], os.path.basename(original)) if r["archive"] else None
    if at and os.path.exists(at):
        if r["fate"] == "archived-first" and os.path.exists(original):
            carried(original, old)
        os.makedirs(os.path.dirname(out), exist_ok=True)
        os.replace(at, out)
        if at != r["staged"] and os.path.exists(r["staged"]):
            os.unlink(r["staged"])
    if original != out and os.path.exists(original):
        if r["fate"] in ("archived", "archived-first"):
            carried(original, old)
        elif r["fate"] == "deleted":
            os.unlink(original)


def applied(manifest: str) -> None:
    """Do what a manifest says, fragment by fragment, and tell of each file in ``placed``: an error there keeps its line from the ledger.

    Ledger lines and what is told go to files named after the fragment, so they are there once.
    """
    with open(manifest, encoding="utf-8") as f:
        said = json.load(f)
    folder = os.path.dirname(manifest)
    for name in said["fragments"]:
        fragment = f"{folder}/{name}.fragment"
        if not os.path.exists(fragment):
            continue  # done before
        lines, told = [], []
        with open(fragment, encoding="utf-8") as f:
            for r in map(json.loads, f):
                error = ""
                try:
                    settled(r)
                except OSError as e:
                    error = str(e)
                told.append(f"{json.dumps({'path': r['path'], 'fate': r['fate'], 'error': error})}\n")
                lines += [f"{r['ledger']}\n"] if r["ledger"] and not error else []
        if lines:
            written_whole(f"{said['ledger']}/part-{name}.csv", "".join(lines))
        written_whole(f"{folder}/placed/{name}.json", "".join(told))
        os.unlink(fragment)
    os.unlink(manifest)


def placed(spark: SparkSession, journal: str) -> DataFrame:
    """(path, fate, error) of every file that a journal's commits have placed, or tried to."""
    return spark.read.schema("path string, fate string, error string").json(f"{journal}/placed")


def recovered(journal: str) -> int:
    """Finish the commits that a lost driver left; how many. Fragments without a manifest were never committed and go."""
    names = os.listdir(journal) if os.path.isdir(journal) else []
    for n in (manifests := [n for n in names if n.endswith(".manifest")]):
        applied(f"{journal}/{n}")
    for n in names:
        if n.endswith(".fragment") and os.path.exists(f"{journal}/{n}"):
            os.unlink(f"{journal}/{n}")
    return len(manifests)


def place(done: DataFrame, journal: str, ledger: str) -> None:
    """Commit (path, staged, out_path, fate, archive, ledger): outputs, originals and ledger lines together.

    ``staged`` is null where nothing was encoded, ``ledger`` where no line is kept. ``fate`` is as ``paths.fate`` says.
    Run one such commit at a time on a journal; call ``recovered`` first after a lost driver.
    """
    spark: SparkSession = done.sparkSession
    spark.dataSource.register(Placement)
    done.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.format(Placement.name()).option("journal", journal).option("ledger", ledger).mode("append").save()
