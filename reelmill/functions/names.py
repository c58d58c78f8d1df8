"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(name: Column) -> Column:
    """The ending of a file name with its dot, as it is written; empty for dot files and a final dot."""
    return F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.substring(suffix(name), 2, 1 << 30))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def cut_tail(text: Column, most: int) -> Column:
    """At most ``most`` characters; what is longer ends in a note."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("… (see log)"))).otherwise(text)
