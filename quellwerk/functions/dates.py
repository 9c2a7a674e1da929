"""Dates from file names, German and mixed notations; impossible dates become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b"
SHORT = r"\b(\d{1,2}\.\d{1,2}\.\d{2})\b"


def _parsed(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def date_from_filename(c: Column | str, pivot: int = 25) -> Column:
    """First dd.mm.yyyy, else first dd.mm.yy; two-digit years up to the pivot are in this century."""
    long = F.regexp_extract(c, LONG, 1)
    short = F.regexp_extract(c, SHORT, 1)
    head, year = F.regexp_replace(short, r"\d\d$", ""), F.regexp_extract(short, r"(\d\d)$", 1)
    full = F.concat(head, F.when(year.try_cast("int") <= pivot, "20").otherwise("19"), year)
    return F.coalesce(_parsed(F.nullif(long, F.lit("")), "d.M.yyyy"), _parsed(F.when(short != "", full), "d.M.yyyy"))


def german_date(c: Column | str) -> Column:
    """d.m.yyyy with '.', '/' or '-' between, years 1900 to 2099; anything else null."""
    dotted = F.regexp_replace(F.trim(c), "[/-]", ".")
    return F.when(dotted.rlike(r"^\d{1,2}\.\d{1,2}\.(19|20)\d{2}$"), _parsed(dotted, "d.M.yyyy"))


def any_date(c: Column | str) -> Column:
    """yyyy-mm-dd, else dd-mm-yyyy, else mm-dd-yyyy."""
    text = F.trim(c)
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"))
    return F.coalesce(*(F.when(text.rlike(shape), _parsed(text, pattern)) for shape, pattern in forms))


def birth_date(c: Column | str) -> Column:
    """A birth date in either notation, years from 1900."""
    found = F.coalesce(german_date(c), any_date(c))
    return F.when(F.year(found) >= 1900, found)


def german_text(c: Column | str) -> Column:
    """yyyy-mm-dd shown as dd.mm.yyyy; other texts as they are."""
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), _parsed(c, "yyyy-MM-dd"))
    return F.coalesce(F.date_format(parsed, "dd.MM.yyyy"), c)


def best_date(dates: Column, modified: Column) -> Column:
    """The latest date of an array, else the file's modification date."""
    return F.coalesce(F.array_max(dates), modified.cast("date"))
