"""Spend categories: names, ids and the older spellings still found in data."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from centwise.functions.text import pattern, trim

# Category names in display order. Ids are their slugs.
CATEGORY_NAMES = [
    "Groceries", "Household", "Dining", "Entertainment", "Subscriptions", "Shopping",
    "Health & Medical", "Travel", "Transportation", "Utilities", "Housing", "Education",
    "Personal Care", "Electronics", "Clothing", "Books & Media", "Pet Care",
    "Home Improvement", "Insurance", "Transfers", "Other",
]


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower().replace(" & ", " "))


CATEGORIES = {_slug(n): n for n in CATEGORY_NAMES}

# Spellings written by older versions of the data.
LEGACY_SPELLINGS = {
    "transport": "transportation",
    "mortgage_rent": "housing",
    "mortgage": "housing",
    "rent": "housing",
    "health": "health-medical",
    "medical": "health-medical",
    "health & medical": "health-medical",
    "books & media": "books-media",
    "personal care": "personal-care",
    "pet care": "pet-care",
    "home improvement": "home-improvement",
}

# The one-off remap accepts these two old names only.
REMAP_OLD_NAMES = {"mortgage_rent": "housing", "transport": "transportation"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def category_id_for(value: Column) -> Column:
    """Id, else name, else older spelling, else slug of the text; null if none fits."""
    raw = trim(value)
    low = F.lower(raw)
    spaced = F.regexp_replace(low, pattern(r"\s*&\s*|\s+and\s+"), " ")
    slug = F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9]+", "-"), r"^-|-$", "")
    ids = list(CATEGORIES)
    return F.coalesce(
        F.when(raw.isin(ids), raw),
        _lookup({n.lower(): i for i, n in CATEGORIES.items()}, low),
        _lookup(LEGACY_SPELLINGS, low),
        F.when(slug.isin(ids), slug),
        _lookup(LEGACY_SPELLINGS, slug),
    )


def category_name_for(category_id: Column) -> Column:
    return _lookup(CATEGORIES, category_id)


def clamp_to_taxonomy(name: Column, names: list[str] | None = None) -> Column:
    return F.when(name.isin(names or CATEGORY_NAMES), name).otherwise(F.lit("Other"))


def legacy_remap(old: Column) -> Column:
    """Slug for an old category id or name; anything unknown becomes ``other``."""
    low = F.lower(F.regexp_replace(old, r" \(legacy\)", ""))
    table = {n.lower(): i for i, n in CATEGORIES.items()} | {i: i for i in CATEGORIES} | REMAP_OLD_NAMES
    return F.coalesce(_lookup(table, low), F.lit("other"))
