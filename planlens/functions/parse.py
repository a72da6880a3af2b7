"""Typed parsing of text cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted date and datetime patterns, in order of preference
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy.MM.dd",
                "d.M.yyyy", "M/d/yyyy"]
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
                    "yyyy-MM-dd'T'HH:mm:ssXXX", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm:ss",
                    "MM/dd/yyyy HH:mm:ss"]
RFC_FORMAT = "d MMM yyyy HH:mm:ss Z"
#: What every date and datetime begins with; most cells end here.
TEMPORAL = r"^([+-]?\d+[-./][+-]?\d+[-./T ]|[A-Za-z]{3},\s*\d|\d{1,2} [A-Za-z]{3} )"
TIME_PATTERN = r"^\d{1,2}:\d{2}(:\d{2})?(\s*[AaPp][Mm])?$"


def cell(c: Column) -> Column:
    """Trimmed text, '' as null."""
    t = F.trim(c)
    return F.when(t != "", t)


def parse_number(c: Column) -> Column:
    """Blanks removed, decimal comma allowed."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s", ""), ",", ".")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def is_time(c: Column) -> Column:
    return F.coalesce(cell(c).rlike(TIME_PATTERN), F.lit(False))


#: Part of a format → all texts it can match.  Fields of one letter take any number of digits, years a sign and more digits.
PARTS = {"yyyy": r"[+-]?\d{4,}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"[+-]?\d+", "d": r"[+-]?\d+", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "XXX": r".+", "'T'": "[Tt]"}


def shape(fmt: str) -> str:
    """Regular expression of all texts that a format can match, and of some that it cannot."""
    return "^" + re.sub("|".join(PARTS) + r"|\.", lambda m: PARTS.get(m[0], r"\."), fmt) + "$"


def _timestamp(c: Column, fmt: str) -> Column:
    # try_to_timestamp is strict on the whole text under the default (corrected) parser policy; each text that it rejects costs
    # an exception, so only texts of the right shape are given to it
    return F.when(c.rlike(shape(fmt)), F.try_to_timestamp(c, F.lit(fmt)))


def parse_datetime(c: Column) -> Column:
    t = cell(c)
    shaped = F.when(~is_time(c) & t.rlike(TEMPORAL), t)
    rfc = F.regexp_replace(shaped, r"^[A-Za-z]{3},\s*", "")
    iso = F.when(shaped.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), shaped.try_cast("timestamp"))
    rfc = F.when(rfc.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), F.regexp_replace(rfc, "GMT$", "+0000"))
    return F.coalesce(*[_timestamp(shaped, f) for f in DATETIME_FORMATS], iso, F.try_to_timestamp(rfc, F.lit(RFC_FORMAT)))


def parse_date(c: Column) -> Column:
    """Date-only patterns first, then the date part of a datetime."""
    t = F.when(~is_time(c) & cell(c).rlike(TEMPORAL), cell(c))
    only = F.coalesce(*[_timestamp(t, f) for f in DATE_FORMATS])
    return F.to_date(F.coalesce(only, parse_datetime(c)))


def parse_time(c: Column) -> Column:
    """24 h or AM/PM text to ``HH:mm:ss``; a time that cannot exist is returned as it is."""
    t = F.when(is_time(c), F.upper(cell(c)))
    h, m = F.regexp_extract(t, r"^(\d{1,2})", 1).cast("int"), F.regexp_extract(t, r":(\d{2})", 1).cast("int")
    s = F.coalesce(F.regexp_extract(t, r":\d{2}:(\d{2})", 1).try_cast("int"), F.lit(0))
    half = F.regexp_extract(t, r"([AP]M)$", 1)
    spaced = t.rlike(r"\s[AP]M$")
    valid24 = (half == "") & (h <= 23)
    valid12 = (half != "") & spaced & h.between(1, 12)
    h24 = F.when(half == "", h).otherwise(h % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when(t.isNull(), None).when((valid24 | valid12) & (m <= 59) & (s <= 59),
                                         F.format_string("%02d:%02d:%02d", h24, m, s)).otherwise(cell(c))


def classify(c: Column) -> Column:
    """``time`` / ``datetime`` / ``date`` / null."""
    other = ~is_time(c) & ~F.coalesce(cell(c).rlike(TEMPORAL), F.lit(False))  # most cells end here
    return (F.when(other, None).when(is_time(c), "time").when(parse_datetime(c).isNotNull(), "datetime")
            .when(parse_date(c).isNotNull(), "date"))


def iso_week(c: Column) -> Column:
    """``2021-W12``: the ISO year is the year of the week's Thursday."""
    d = F.to_date(c)
    return F.concat(F.year(F.date_add(F.trunc(d, "week"), 3)).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
