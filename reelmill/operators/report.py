"""Aggregates over results: the summary, the savings, the notes and the buckets of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.functions.names import cut_tail
from reelmill.settings import PIXELS_1080P, REFERENCE_FPS, Settings, density

#: Outcomes in the order of the report.
ORDER = ("shrink", "transcode", "remux", "skip-at-tier", "skip-under-tier", "skip-modern", "skip-existing", "skip-min-saving", "skip-incompatible", "skip-codec", "resume", "error")
CHANGED = ("shrink", "transcode", "remux")


def changed() -> Column:
    return F.col("outcome").isin(*CHANGED)


def tally(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(changed()).alias("changed"), F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(~changed() & (F.col("outcome") != "error")).alias("left_alone"),
    )


def by_outcome(results: DataFrame) -> DataFrame:
    """Files of each outcome that the report shows, with its place in it."""
    place = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("outcome"))
    return results.groupBy("outcome").agg(F.count("*").alias("files")).withColumn("place", place).where("place > 0")


def space_saved(results: DataFrame) -> DataFrame:
    """Bytes before and after over changed files; no row where none was changed."""
    sums = results.where(changed()).agg(F.count("*").alias("files"), F.sum("src_bytes").alias("before"), F.sum("out_bytes").alias("after")).where("files > 0")
    return sums.withColumn("saved", F.col("before") - F.col("after")).withColumn("percent", F.when(F.col("before") > 0, F.col("saved") / F.col("before") * 100).otherwise(0.0))


def notes(results: DataFrame, order: list[str]) -> DataFrame:
    return results.select(*order, "path", F.posexplode("notes").alias("nth", "note")).select(*order, "path", "nth", "note.level", "note.message")


def bucket() -> Column:
    """ok, skip or fail: errors and warned files fail."""
    return F.when((F.col("outcome") == "error") | F.exists("notes", lambda n: n["level"] == "WARN"), "fail").when(changed(), "ok").otherwise("skip")


def saved_bytes() -> Column:
    return F.when(changed(), F.greatest(F.lit(0), F.col("src_bytes") - F.col("out_bytes"))).otherwise(0).cast("long")


def size_text(n: Column) -> Column:
    """A byte count as text, 1,024 to the unit."""
    h = q.human(n, 1024, 1)
    return F.concat(F.format_string("%.1f", h["amount"]), F.lit(" "), h["unit"])


def lines(results: DataFrame) -> DataFrame:
    """The report as (part, nth, path, line): head, outcomes in their order, space saved, then every note of every file."""
    one = lambda df, part, nth, path, line: df.select(F.lit(part).alias("part"), nth.cast("long").alias("nth"), path.alias("path"), line.alias("line"))
    none = F.lit("")
    head = one(tally(results), 0, F.lit(0), none, F.format_string("%d files: %d changed, %d left as they are, %d errors", "total", "changed", "left_alone", "errors"))
    table = one(by_outcome(results), 1, F.col("place"), none, F.format_string("  %-24s%8d", "outcome", "files"))
    saved = F.format_string("%d files: %s before, %s after, %s saved (%.1f%%)", "files", size_text(F.col("before")), size_text(F.col("after")), size_text(F.col("saved")), "percent")
    space = one(space_saved(results), 2, F.lit(0), none, saved)
    said = one(notes(results, []), 3, F.col("nth"), F.col("path"), F.format_string("  [%s] %s: %s", "level", "message", "path"))
    return head.unionByName(table).unionByName(space).unionByName(said)


#: How a list names files that were left alone.
LEFT_ALONE = {
    "skip-at-tier": "already efficient", "skip-under-tier": "below your quality tier", "skip-modern": "already modern", "skip-existing": "already converted",
    "skip-min-saving": "saving too small", "skip-incompatible": "codec kept", "skip-non-mp4": "left as-is", "skip-codec": "unsupported codec",
    "skip-second-generation": "already encoded by this tool", "resume": "already efficient",
}
#: What is said of a file that can't be read, and of an error without a reason.
UNREADABLE, FAILED = "couldn't read file", "encode failed"


#: How lists and consoles speak of an outcome, for results with and without a warning: (severity, what is said).
#: What is said is words, "sizes" (before and after) or "reason" (the first note).
SPOKEN = {(x, w): ("warn" if w else "", "sizes") for x in CHANGED for w in (True, False)}
SPOKEN |= {("error", w): ("err", "reason") for w in (True, False)}
SPOKEN |= {(x, w): ("warn" if w else "", words) for x, words in LEFT_ALONE.items() for w in (True, False)}
SPOKEN |= {("skip-codec", True): ("warn", UNREADABLE)}
#: Characters of a reason that a list shows.
REASON = 58


def short_size(n: Column) -> Column:
    """A byte count, 1,000 to the unit: two decimals from a KB on (ties go up), GB at most."""
    n = F.greatest(F.lit(0), n).cast("long")

    def scaled(unit: int, name: str) -> Column:
        hundredths = F.floor((n + unit // 200) / (unit // 100)).cast("long")
        return F.format_string(f"%d.%02d {name}", F.floor(hundredths / 100).cast("long"), hundredths % 100)

    return F.when(n >= 10**9, scaled(10**9, "GB")).when(n >= 10**6, scaled(10**6, "MB")).when(n >= 1000, scaled(1000, "KB")).otherwise(F.format_string("%d B", n))


def spoken(results: DataFrame) -> DataFrame:
    """``results`` with ``warned``, and severity and ``says`` of its rule (null where its outcome has none)."""
    rules = results.sparkSession.createDataFrame([(*k, *v) for k, v in SPOKEN.items()], "outcome string, warned boolean, rule string, says string")
    return results.withColumn("warned", F.exists("notes", lambda n: n["level"] == "WARN")).join(F.broadcast(rules), ["outcome", "warned"], "left")  # some twenty rules


def listed(results: DataFrame) -> DataFrame:
    """``results`` with bucket, severity and label, as one line of a list shows them."""
    said = {"sizes": F.concat_ws(" → ", short_size(F.col("src_bytes")), short_size(F.col("out_bytes"))), "reason": cut_tail(F.coalesce(F.nullif(F.get("notes", F.lit(0))["message"], F.lit("")), F.lit(FAILED)), REASON)}
    plain = F.translate(F.regexp_replace("outcome", "skip-", ""), "-", " ")
    label = F.coalesce(*[F.when(F.col("says") == k, v) for k, v in said.items()], F.col("says"), plain)
    unsized = (F.col("says") == "sizes") & ~F.coalesce(F.col("src_bytes") > 0, F.lit(False))
    severity = F.coalesce(F.nullif("rule", F.lit("")), F.when(F.col("warned"), "warn").when(F.size("notes") > 0, "note").otherwise(""))
    rows = spoken(results).withColumns({"bucket": bucket(), "severity": severity, "label": F.when(unsized, F.col("outcome")).otherwise(label)})
    return rows.select(*results.columns, "bucket", "severity", "label")


def header(s: Settings, dry: bool = False) -> dict[str, str]:
    """What a run is about to do, by topic; only topics that apply.

    A density of one's own gives the megabits of 1080p at 30 frames that it means.
    """
    full_hd = lambda share: f"{s.bpp * share * PIXELS_1080P * REFERENCE_FPS / 1e6:.1f}"
    own = abs(s.bpp - density(s.tier)) > 1e-9
    topics = {
        "quality": s.tier.lower(), "bits a pixel": f"{s.bpp:.4f}" if own else "", "H.264 at 1080p30": f"{full_hd(1.0)} Mbps",
        "H.265 at 1080p30": f"{full_hd(s.hevc[0])} Mbps" if s.codec == "h265" else "",
        "from": s.src, "to": s.output_dir if s.output_mode == "separate" else "", "codec": s.codec, "encoder": s.encoder, "originals": s.source_action, "at once": str(s.jobs),
        "encoded anew": f"from {s.tolerance:.0%} of the target", "remux": "non-MP4 files" if s.remux_to_mp4 else "", "transcode": "legacy codecs" if s.compat_transcode else "",
        "left out under": f"{s.ignore_under / 1e6:g} MB" if s.ignore_under else "", "left out over": f"{s.ignore_over / 1e6:g} MB" if s.ignore_over else "",
        "left out": ", ".join([*(f".{x}" for x in s.ignore_exts), *map(repr, s.ignore_names)]), "resume": "from the ledger" if s.ledger_enabled and not dry else "",
    }
    return {k: v for k, v in topics.items() if v}


def console(results: DataFrame) -> DataFrame:
    """What is said of each result as (path, nth, line): its name, what became of it and the share saved, then its notes."""
    rows = spoken(results)
    became = F.when(F.col("says").isin("sizes", "reason"), F.col("outcome")).otherwise(F.coalesce("says", "outcome"))
    smaller = F.when((F.col("says") == "sizes") & (F.col("src_bytes") > 0), F.format_string(", %.0f%% smaller", q.half_even((1 - F.col("out_bytes") / F.col("src_bytes")) * 100).cast("double"))).otherwise("")
    first = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(": "), became, smaller)
    notes = F.transform("notes", lambda n: F.concat(F.lit("  "), F.lower(n["level"]), F.lit(": "), n["message"]))
    return rows.select("path", F.posexplode(F.concat(F.array(first), F.coalesce(notes, F.array()))).alias("nth", "line"))


def failed(results: DataFrame) -> DataFrame:
    """The paths that a retry takes."""
    return results.where(F.col("outcome") == "error").select("path")


def disposals(done: DataFrame) -> DataFrame:
    """How many originals (fate, error) went where, and how many could not."""
    return done.groupBy("fate").agg(F.count_if(F.col("error") == "").alias("done"), F.count_if(F.col("error") != "").alias("failed"))
