"""Normalisers of field values, and the flags of implausible ones.  Patterns, names of flags and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.text import fold, strip


def height(c: Column) -> Column:
    p = r"(?i)(\d)\s*m[. ètre]*\s*(\d{1,3})\s*(?:c|cent|cm|mm)?"
    made = F.concat(F.regexp_extract(c, p, 1), F.lit("m "), F.regexp_extract(c, p, 2).try_cast("int").cast("string"), F.lit("cm"))
    return F.when(c.rlike(p), made).otherwise(c)


def day(c: Column) -> Column:
    first = strip(c).rlike(r"(?i)\A1\s*(?:er|ere|ère|re)\.?\z") | (F.lower(strip(c)) == "premier")
    return F.when(first, F.lit("1")).otherwise(c)


def regiment(c: Column) -> Column:
    p = r"(?iU)(\d+)\s*(?:er|ère|re|e)?\b"
    n = F.regexp_extract(c, p, 1)
    return F.when(c.rlike(p), F.concat(n, F.when(n == "1", F.lit("er")).otherwise(F.lit("e")), F.lit(" Régt"))).otherwise(c)


def ordinal(c: Column) -> Column:
    """Empty where the value is the form's own numbering."""
    p = r"(?iU)\A(?:\s*\d+\s*(?:er|ère|e|°|<sup>e</sup>)\.?\s*)+(?:fils|fille)?\s*(?:de|d['’])?"
    return F.when(c.rlike(p), F.lit("")).otherwise(c)


#: Departments that a place of enlistment has by default.
DEFAULT_DEPARTMENTS = ("aude", "l'aude", "laude", "tarn")


def department(c: Column) -> Column:
    return F.when(fold(c).isin(*DEFAULT_DEPARTMENTS), F.lit("")).otherwise(c)


def plausibility(value: Column, is_day: Column, is_year: Column, is_height: Column) -> Column:
    """Flags of a value that is malformed or out of range for its kind of field."""
    v = strip(value)
    some = v != ""
    number = v.try_cast("int")
    form = r"\A(\d)m (\d{1,2})cm\z"
    return F.array_compact(
        F.array(
            F.when(is_day & some & ~v.rlike(r"\A\d+\z"), F.lit("day-format")),
            F.when(is_day & some & v.rlike(r"\A\d+\z") & ~F.coalesce(number.between(1, 31), F.lit(False)), F.lit("impossible-day")),
            F.when(is_year & some & ~v.rlike(r"\A\d{4}\z"), F.lit("year-format")),
            F.when(is_year & v.rlike(r"\A\d{4}\z") & ~number.between(1750, 1960), F.lit("year-out-of-range")),
            F.when(is_height & some & ~v.rlike(form), F.lit("height-format")),
            F.when(is_height & v.rlike(form) & ~F.regexp_extract(v, form, 1).isin("1", "2"), F.lit("height-implausible")),
        )
    )


def length_window(n: Column) -> tuple[Column, Column]:
    """Lengths of dictionary values that a value of length n is compared with."""
    low = F.greatest(F.lit(2), F.bround(n * 0.7).cast("int"))
    return low, (n + F.greatest(F.lit(3), F.bround(n * 0.5).cast("int"))).cast("int")
