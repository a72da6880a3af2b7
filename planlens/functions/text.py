"""Name keys and small text functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: legal forms cut from the front of an organization name
LEGAL_FORMS = ["гбу", "гку", "гауз", "фгбу", "обуз", "бу", "ао"]


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalization; Spark has no built-in for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _base(c: Column) -> Column:
    return F.replace(F.lower(nfkc(F.replace(F.coalesce(c, F.lit("")), F.lit("№"), F.lit(" ")))), F.lit("ё"), F.lit("е"))


def name_key(c: Column) -> Column:
    """Key of a document-type name: words joined by ``_``."""
    t = F.regexp_replace(_base(c), "[«»„“”\"]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(t, "[^a-zа-я0-9]+", " ")), " +", "_")


def org_key(c: Column) -> Column:
    """Key of an organization name: words joined by a blank, the word ``no`` dropped."""
    t = F.regexp_replace(_base(c), r"\bno(?=\s|\d|$)", " ")
    return F.trim(F.regexp_replace(t, "[^a-zа-я0-9]+", " "))


def name_variants(c: Column, region_suffixes: Sequence[str] = ()) -> Column:
    """Array of the organization key and the key without legal form and region suffix."""
    key = org_key(c)
    short = F.regexp_replace(key, "^(" + "|".join(LEGAL_FORMS) + r")\s+", "")
    for s in region_suffixes:
        short = F.regexp_replace(short, rf"\s+{s}$", "")
    return F.filter(F.array_distinct(F.array(key, F.trim(short))), lambda v: v != "")


def strip_version(c: Column) -> Column:
    """Drop a trailing ``(CDA)`` / ``(PDF/A-1)`` with its edition number."""
    return F.trim(F.regexp_replace(c, r"(?iu)\s*\((CDA|PDF/A-1)\)(\s+Редакция\s+\d+)?\s*$", ""))


def section_code(c: Column) -> Column:
    """Leading section number such as ``3.2``, '' when there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d+(?:\.\d+)*)", 1)


def parse_age(c: Column) -> Column:
    """Digits to int, ``> 89`` to 90, anything else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike(r"^>\s*89$"), F.lit(90))
