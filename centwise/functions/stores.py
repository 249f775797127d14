"""Which bank merchants can give an itemised receipt.

Patterns are applied to normalised merchants, which are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.text import let, normalize_merchant, normalize_store

# Fixed values: (chain, pattern, pattern that vetoes it), tried in this order.
RECEIPT_CHAINS = [
    ("Costco", r"\bCOSTCO\b", None),
    ("Sam's Club", r"\bSAM S CLUB\b|\bSAMS CLUB\b|\bSAMSCLUB\b", None),
    ("BJ's", r"\bBJ ?S (WHOLESALE|WHSE|CLUB)\b", None),
    ("Walmart", r"\bWAL ?MART\b|\bWM SUPERCENTER\b|\bWM SUPERC\b", None),
    ("Target", r"\bTARGET\b", None),
    ("Fred Meyer", r"\bFRED MEYER\b", None),
    ("Meijer", r"\bMEIJER\b", None),
    ("Lowes Foods", r"\bLOWE ?S FOODS\b", None),
    ("Home Depot", r"\bHOME ?DEPOT\b", None),
    ("Lowe's", r"\bLOWE ?S\b", None),
    ("Menards", r"\bMENARDS\b", None),
    ("IKEA", r"\bIKEA\b", None),
    ("Best Buy", r"\bBEST ?BUY\b", None),
    ("Kroger", r"\bKROGER\b", None),
    ("Safeway", r"\bSAFEWAY\b", None),
    ("Albertsons", r"\bALBERTSONS?\b", None),
    ("Trader Joe's", r"\bTRADER JOE S\b|\bTRADER JOES\b", None),
    ("Whole Foods", r"\bWHOLE ?FOODS\b|\bWHOLEFDS\b|\bWFM\b", None),
    ("Aldi", r"\bALDI\b", None),
    ("H-E-B", r"\bH ?E ?B\b", None),
    ("Publix", r"\bPUBLIX\b", None),
    ("Wegmans", r"\bWEGMANS\b", None),
    ("WinCo", r"\bWINCO\b", None),
    ("Sprouts", r"\bSPROUTS\b", None),
    ("Walgreens", r"\bWALGREENS\b", None),
    ("CVS", r"\bCVS\b", r"\bCAREMARK\b"),
    ("Rite Aid", r"\bRITE ?AID\b", None),
]
FUEL_WORDS = r"\b(GAS|FUEL|GASOLINE|PETROL)\b"
# Single words too common to name a store.
GENERIC_WORDS = [
    "STORE", "STORES", "MARKET", "MARKETS", "SHOP", "SHOPS", "MART", "FOODS", "FOOD", "GROCERY", "GROCER",
    "PHARMACY", "SUPERMARKET", "DEPOT", "CENTER", "CENTRE", "OUTLET", "WAREHOUSE", "CLUB", "HARDWARE", "RECEIPT", "TOTAL",
]


def is_fuel(line: Column) -> Column:
    return line.rlike(FUEL_WORDS)


def builtin_chain(merchant: Column) -> Column:
    """Chain named by the merchant text; fuel lines and unknown merchants give null."""
    def chain(line: Column) -> Column:
        out = F.when(is_fuel(line) | (line == ""), F.lit(None).cast("string"))
        for name, pat, veto in RECEIPT_CHAINS:
            hit = line.rlike(pat)
            if veto:
                hit = hit & ~line.rlike(veto)
            out = out.when(hit, F.lit(name))
        return out

    return let(normalize_merchant(merchant), chain)


def learned_key(store: Column) -> Column:
    """Key under which a household's own store name is recognised on bank lines."""
    return normalize_store(normalize_merchant(normalize_store(store)))


def learnable(key: Column) -> Column:
    def fits(k: Column) -> Column:
        words = F.size(F.split(k, " "))
        weak_word = (words < 2) & ((F.length(k) < 4) | k.isin(GENERIC_WORDS))
        return (k != "") & ~k.rlike(r"^[0-9]+$") & ~weak_word & ~is_fuel(k)

    return let(key, fits)


def leads(longer: Column, shorter: Column) -> Column:
    """Whole-word prefix test on single-spaced text."""
    return F.startswith(F.concat(longer, F.lit(" ")), F.concat(shorter, F.lit(" ")))


def has_run(text: Column, words: Column) -> Column:
    """Whole-word contiguous containment on single-spaced text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))
