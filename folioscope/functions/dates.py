"""Dates in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import SPACES, trimmed

_DATE = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{4})"


def parsed_day_first(s: Column) -> Column:
    """A date such as 3.7.2024, whose separators may be mixed; null if there is no such day."""
    s = trimmed(s)
    return F.when(s.rlike(f"^{_DATE}$"), F.try_to_date(F.regexp_replace(s, "[-/]", "."), "d.M.yyyy"))


def day_first(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parsed_file_name(name: Column, now: Column) -> Column:
    """struct(author, date_text, date, from_name): the author and date that a file name tells.

    The date stands after the last underscore, or else anywhere; without one it is `now`.
    """
    stem = trimmed(F.regexp_replace(name, r"\.[^.]+$", ""))
    spaced = lambda s, cut: trimmed(F.regexp_replace(s, f"[{cut}{SPACES}]+", " "))
    before = F.regexp_extract(stem, r"^(?s)(.+)_([^_]*)$", 1)
    last = parsed_day_first(F.regexp_extract(stem, r"^(?s)(.+)_([^_]*)$", 2))
    found = F.regexp_extract(stem, _DATE, 0)
    loose = parsed_day_first(found)
    at = F.instr(stem, found)
    rest = F.concat(F.substring(stem, F.lit(1), at - 1), F.substring(stem, at + F.length(found), F.length(stem)))
    or_ = lambda s, other: F.coalesce(F.nullif(s, F.lit("")), other)
    date = F.coalesce(last, F.when(found != "", loose))
    author = F.when(last.isNotNull(), or_(spaced(before, "_"), stem)).when((found != "") & loose.isNotNull(), or_(spaced(rest, r"_.\-"), stem)).otherwise(or_(spaced(stem, "_"), F.lit("Unknown")))
    whole = F.coalesce(date, now)
    return F.struct(author.alias("author"), day_first(whole).alias("date_text"), whole.alias("date"), date.isNotNull().alias("from_name"))
