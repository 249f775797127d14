"""Keyword classification: ordered rules, the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.taxonomy import clamp_to_taxonomy
from centwise.functions.text import ascii_fold, let, present

# Fixed values: (category, keyword pattern), tried in this order, case ignored.
KEYWORD_RULES = [
    ("Subscriptions", r"netflix|spotify|hulu|disney\+|disney plus|apple tv\+|amazon prime|paramount\+|peacock|hbo\b|showtime|youtube premium|tidal|deezer"),
    ("Groceries", r"whole foods|trader joe|kroger|safeway|aldi|publix|wegman|fresh market|sprouts"),
    ("Dining", r"starbucks|mcdonald|chipotle|domino'?s|pizza hut|burger king|taco bell|subway\b|panera|shake shack|dunkin|doordash|grubhub|uber eats"),
    ("Transportation", r"\buber\b(?!\s*eats)|\blyft\b|taxi\b|transit\b|metro\b|bart\b|\bmta\b|amtrak"),
    ("Health & Medical", r"walgreen|cvs\b|pharmacy|clinic\b|hospital|dental|medical\b|lab corp|quest diagnostics"),
    ("Electronics", r"usb-?c? cable|usb hub|\bheadphone|\bkeyboard\b|\blaptop\b|\bmonitor\b|\bcharger\b|\btablet\b|\bkindle\b"),
    ("Books & Media", r"\bpaperback\b|\bhardcover\b|\bebook\b|\baudible\b|kindle book|\bmagazine\b|\bnovel\b"),
    ("Clothing", r"\bclothing\b|\bshirt\b|\bpants\b|\bdress\b|\bshoes?\b|\bnike\b|\badidas\b|\bgap\b|h&m\b|\bzara\b|old navy|uniqlo"),
    ("Home Improvement", r"home depot|lowe'?s\b|hardware store|\blumber\b|\bplumbing\b"),
    ("Utilities", r"electric bill|water bill|gas bill|\butility\b|comcast|verizon|at&t|t-mobile|spectrum\b|xfinity"),
    ("Housing", r"\brent\b|\bmortgage\b|property tax|hoa fee|\blease\b"),
    ("Travel", r"airline\b|\bflight\b|\bhotel\b|airbnb|vrbo|expedia|booking\.com|marriott|hilton|\bdelta\b|united airlines|southwest"),
    ("Insurance", r"insurance\b|geico|progressive\b|allstate|state farm|\baetna\b|\banthemb\b|cigna"),
    ("Personal Care", r"\bsalon\b|\bhaircut\b|\bspa\b|nail salon|beauty supply|\bbarber\b|\bulta\b|sephora"),
    ("Pet Care", r"petco|petsmart|veterinar|animal hospital|\bchewy\b"),
    ("Education", r"\btuition\b|\buniversity\b|\bcollege\b|coursera|udemy|khan academy"),
    ("Household", r"paper towel|bath tissue|facial tissue|toilet paper|\bbounty\b|\bcharmin\b|\bcottonelle\b|\bkleenex\b|detergent|laundry|dryer sheet|fabric softener|\bdowny\b|dish soap|dishwasher pod|dishwasher tab|\bclorox\b|\blysol\b|disinfecting wipe|trash bag|garbage bag|\bziploc\b|\bhefty\b|aluminum foil|plastic wrap|\bswiffer\b|\bduracell\b|\benergizer\b|light ?bulb|air freshener|\bfebreze\b"),
    ("Shopping", r"\bamazon\b|\btarget\b|walmart|ebay\b|etsy\b|best buy|costco|sam'?s club"),
]


def keyword_category(text: Column, rules: list[tuple[str, str]] = KEYWORD_RULES) -> Column:
    """``struct(category, keyword)`` of the first rule that matches, else null.

    The text is folded once.  One alternation of all rules on its lower-case form,
    which is quicker than matching without case, turns away texts without any hit
    in one scan; the rest is tried rule by rule, and only the deciding rule reads
    the keyword.
    """
    any_rule = "|".join(f"(?:{raw})" for _, raw in rules)

    def first_hit(both: Column) -> Column:
        out = None
        for category, raw in rules:
            hit = F.struct(F.lit(category).alias("category"), F.regexp_extract(both["text"], "(?i)" + raw, 0).alias("keyword"))
            seen = both["low"].rlike(raw)
            out = F.when(seen, hit) if out is None else out.when(seen, hit)
        return F.when(both["low"].rlike(any_rule), out)

    return let(let(ascii_fold(text), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"))), first_hit)


def search_text(merchant: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.when(present(merchant), merchant), F.when(present(description), description))


def classified(merchant: Column, hit: Column) -> Column:
    """``struct(category, rationale, source)`` from a rule hit on an item."""
    category = clamp_to_taxonomy(F.coalesce(hit["category"], F.lit("Other")))
    rationale = F.concat(
        F.lit("merchant: "), F.coalesce(merchant, F.lit("")),
        F.lit('; keyword match: "'), F.coalesce(hit["keyword"], F.lit("no match")), F.lit('" → '), category,
    )
    return F.struct(category.alias("category"), rationale.alias("rationale"), F.lit("item_heuristic").alias("source"))


def classify(merchant: Column, description: Column) -> Column:
    return classified(merchant, keyword_category(search_text(merchant, description)))


def merchant_fallback(merchant: Column) -> Column:
    """Same rules on the bank merchant alone, for lines that have no items."""
    hit = keyword_category(merchant)
    category = clamp_to_taxonomy(F.coalesce(hit["category"], F.lit("Other")))
    rationale = F.concat(
        F.lit("merchant: "), merchant, F.lit('; no item data, merchant keyword fallback: "'),
        F.coalesce(hit["keyword"], F.lit("no keyword match")), F.lit('" → '), category,
    )
    return F.struct(category.alias("category"), rationale.alias("rationale"), F.lit("merchant_fallback").alias("source"))


def merchant_from_rationale(rationale: Column) -> Column:
    """Text between ``merchant: `` and the first semicolon (or the end)."""
    found = F.regexp_extract(rationale, r"(?s)^merchant: ([^;]*)", 1)
    return F.when(rationale.startswith("merchant: "), F.trim(found))
