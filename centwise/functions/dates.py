"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.text import SPACE, let, trim

# Month names and the abbreviations accepted for them.
MONTH_WORDS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10,
    "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}


def _month_number(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTH_WORDS.items() for x in kv])
    return table[F.lower(word)]


def to_date_any(c: Column) -> Column:
    """ISO (with optional time), Y/M/D, US M/D/Y and M-D-Y, ``Jan 5, 2026``, ``5 Jan 2026``; else null."""
    return let(trim(c), _read_date)


def _read_date(s: Column) -> Column:
    # a form that doesn't fit gives null, not an empty text: the parser raises an error for each text that it can't read
    def found(p: str) -> Column:
        return F.nullif(F.regexp_extract(s, p, 1), F.lit(""))

    word_first = rf"^([A-Za-z]+)\.?{SPACE}+([0-9]{{1,2}}),?{SPACE}+([0-9]{{4}})$"
    day_first = rf"^([0-9]{{1,2}}){SPACE}+([A-Za-z]+)\.?,?{SPACE}+([0-9]{{4}})$"

    def spelled(p: str, word: int, day: int) -> Column:
        month = _month_number(F.regexp_extract(s, p, word))
        return F.when(s.rlike(p), F.try_to_date(F.concat_ws("-", F.regexp_extract(s, p, 3), month.cast("string"), F.regexp_extract(s, p, day)), "yyyy-M-d"))

    return F.coalesce(
        F.try_to_date(found(r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[T ].*)?$"), "yyyy-M-d"),
        F.try_to_date(found(r"^([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})$"), "yyyy/M/d"),
        F.try_to_date(F.replace(found(r"^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})$"), F.lit("-"), F.lit("/")), "M/d/yyyy"),
        spelled(word_first, 1, 2),
        spelled(day_first, 2, 1),
    )


def excel_serial_to_date(serial: Column) -> Column:
    """1900 date system: serial 60 never existed, later serials sit one day low."""
    day = F.floor(serial).cast("int")
    shifted = day - F.when(day > 60, 1).otherwise(0)
    return F.when((serial >= 1) & (day != 60), F.date_add(F.lit("1899-12-31").cast("date"), shifted))


def days_between(a: Column, b: Column) -> Column:
    """Absolute day distance; null when either side is missing, so filters reject it."""
    return F.abs(F.date_diff(a, b)).cast("bigint")


def day_number(d: Column) -> Column:
    return F.unix_date(d).cast("bigint")


def month_of(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_index(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d) - 1).cast("bigint")


def month_text(idx: Column) -> Column:
    year = F.floor(idx / 12).cast("bigint")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(idx, F.lit(12)) + 1).cast("string"), 2, "0"))


def within_ask_window(posted: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(F.date_diff(as_of, posted).between(-1, days), F.lit(False))
