"""Scan of free text for payment and identity data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.text import pattern

# Fixed values: (kind, pattern of the text to report).
SENSITIVE = [
    ("pan", r"[0-9]{13,19}"),
    ("pan_grouped", r"\b(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b"),
    ("masked_last4", r"[*xX#•●]{2,}[ -]?[0-9]{4}\b"),
    ("ending_in", r"(?i)ending(?:\s+in)?\s*[:#-]?\s*[0-9]{4}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("api_key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("api_key", r"\bAKIA[A-Z0-9]{16}\b"),
]


def sensitive_hits(text: Column) -> Column:
    """Every hit as ``array<struct<kind, match>>``; the scan of each pattern runs once per text."""
    def scan(kind: str, p: str) -> Column:
        def tag(m: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), m.alias("match"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern(p)), F.lit(0)), tag)

    found = F.concat(*[scan(kind, p) for kind, p in SENSITIVE])
    # every pattern needs a run of digits or a key prefix; most texts have neither
    return F.when(text.rlike("[0-9]{3}|sk-|AKIA"), found).otherwise(F.array().cast("array<struct<kind:string,match:string>>"))
