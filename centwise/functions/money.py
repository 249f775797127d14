"""Money and confidence arithmetic. Cents are BIGINT; halves round up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.text import SPACE, let


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


_SIGNED = rf"([-+]?){SPACE}*([^()]*?){SPACE}*(-?)"
_PRINTED = rf"(?s)^{SPACE}*(?:\({SPACE}*{_SIGNED}{SPACE}*\)|{_SIGNED}){SPACE}*$"
#: The forms that most amounts have; their cents are their digits.
_PLAIN = r"^(?:-?\$?[0-9]{1,12}\.[0-9]{2}|\(\$?[0-9]{1,12}\.[0-9]{2}\))\z"


def amount_to_cents(c: Column) -> Column:
    """Parse a printed amount; null where it cannot be read.

    Accepts accounting brackets, a leading or trailing sign, currency marks and
    thousands separators.  The magnitude is rounded before the sign is applied.
    """
    return let(c, lambda text: F.when(text.rlike(_PLAIN), _plain_cents(text)).otherwise(_printed_cents(text)))


def _plain_cents(c: Column) -> Column:
    return F.translate(c, "-$.()", "").cast("bigint") * F.when(c.startswith("-") | c.startswith("("), -1).otherwise(1)


def _printed_cents(c: Column) -> Column:
    def part(bracketed: int, plain: int) -> Column:
        return F.concat(F.regexp_extract(c, _PRINTED, bracketed), F.regexp_extract(c, _PRINTED, plain))

    digits = F.regexp_replace(part(2, 5), f"[,$£€]|{SPACE}", "")
    number = F.regexp_extract(digits, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)$", 1).try_cast("double")
    minus = c.rlike(rf"^{SPACE}*\(").cast("int") + (part(1, 4) == "-").cast("int") + (part(3, 6) == "-").cast("int")
    return half_up(number * F.lit(100.0)) * F.when(minus % 2 == 1, -1).otherwise(1)


def dollars_to_cents(c: Column) -> Column:
    return half_up(c.cast("double") * F.lit(100.0))


def bank_to_spend(c: Column) -> Column:
    """Bank sign (debit negative) to spend sign (purchase positive)."""
    return -c


def to_pct(conf: Column) -> Column:
    return half_up(conf * F.lit(100.0))


def from_pct(pct: Column) -> Column:
    return pct.cast("double") / F.lit(100.0)


# Stored match status to the status shown on reads.
READ_STATUS = {"pending": "ambiguous", "matched": "confirmed", "manual": "confirmed"}


def read_status(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for stored, shown in READ_STATUS.items():
        out = F.when(status == stored, F.lit(shown)).otherwise(out)
    return out


def delta_pct(observed: Column, comparison: Column) -> Column:
    change = (observed - comparison).cast("double") / F.nullif(comparison, F.lit(0).cast("bigint")).cast("double")
    return F.when(comparison == 0, F.lit(0).cast("bigint")).otherwise(half_up(change * F.lit(100.0)))


def route(conf: Column, threshold: float) -> Column:
    return F.when(conf >= F.lit(float(threshold)), F.lit("auto_linked")).otherwise(F.lit("review"))
