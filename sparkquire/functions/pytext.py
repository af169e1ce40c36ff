"""Text columns with Unicode-aware patterns and the string forms that the data model asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and only line feeds end a line.
FLAGS = "(?Ud)"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(c: Column, length: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"), 1, length)


def token_estimate(c: Column) -> Column:
    """One token for four characters."""
    return F.floor(F.length(c) / 4)


def json_string(c: Column) -> Column:
    """The JSON form of a string without control characters other than line feed and tab; other characters stay as they are."""
    escaped = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))
