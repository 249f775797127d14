"""Text normalisers as Column expressions.

Regular expressions here spell out the white-space class and an ASCII word
boundary, so tabs and no-break spaces are white space and accented letters are
not word characters whatever the JVM's own defaults are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def pattern(p: str) -> str:
    """Expand the portable ``\\b`` and ``\\s`` of a rule into explicit classes."""
    return p.replace(r"\b", EDGE).replace(r"\s", SPACE)


def ascii_fold(c: Column) -> Column:
    """Non-ASCII white space as a tab (so no literal blank matches it), every other non-ASCII character as a control character.

    ASCII keyword patterns match the folded text exactly where they match the
    original, and the JVM's own word boundary is then the ASCII one.
    """
    wide_space = "[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    return F.regexp_replace(F.regexp_replace(c, wide_space, chr(9)), "[^\\x00-\\x7F]", chr(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(template: str, *values: Column | str) -> Column:
    """``template`` with each ``{}`` replaced by a value; a null is written as null, like by ``format_string``, which is slower."""
    parts = template.split("{}")
    texts = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")) for v in values]
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(texts, parts[1:], strict=True) for x in (v, F.lit(p))])


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Trim and collapse white space to single blanks."""
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def even(c: Column) -> Column:
    """True for ASCII text that ``squeeze`` leaves as it is; looked at without a pattern, since most keys are of this kind."""
    blank = F.lit(False)
    for b in ("  ", *"\t\n\x0b\f\r"):
        blank = blank | c.contains(b)
    return (F.length(c) == F.octet_length(c)) & ~(c.startswith(" ") | c.endswith(" ") | blank)


def normalize_merchant(c: Column) -> Column:
    kept = F.regexp_replace(F.upper(c), f"(?:(?!{SPACE})[^A-Z0-9])+", " ")
    return squeeze(kept)


def clean_bank_merchant(c: Column) -> Column:
    """Drop ``*tail`` and ``#123`` references, then normalise."""
    no_tail = F.regexp_replace(c, rf"\*(?:(?!{SPACE}).)*", " ")
    no_ref = F.regexp_replace(no_tail, rf"#{SPACE}*[A-Za-z0-9_]+", " ")
    return normalize_merchant(no_ref)


def _key(c: Column) -> Column:
    return F.when(even(c), F.upper(c)).otherwise(_uneven_key(c))


def _uneven_key(c: Column) -> Column:
    plain_quotes = F.regexp_replace(c, r"[\u2018\u2019\u201b\u02bc]", "'")
    return F.upper(squeeze(plain_quotes))


# Company-form words that carry no identity.
STORE_NOISE = ["WHSE", "WHOLESALE", "INC", "LLC", "CORP"]


def _identity_words(plain: Column) -> Column:
    return F.filter(
        F.split(plain, " "),
        lambda t: ~t.rlike(r"^#[0-9]+$") & ~t.isin(STORE_NOISE) & ~t.rlike(r"^[^A-Z0-9]+$"),
    )


def normalize_store(c: Column) -> Column:
    def rest(plain: Column) -> Column:
        # trailing all-digit words go, but one word always stays
        joined = F.regexp_replace(F.array_join(_identity_words(plain), " "), r"^(.*?[^ ])(?: [0-9]+)+$", "$1")
        return F.coalesce(F.nullif(joined, F.lit("")), plain)

    key = _key(c)
    # letters and none of the noise words: all words stay
    changes = key.rlike(rf"[^A-Z ]|(?:^| )(?:{'|'.join(STORE_NOISE)})(?: |$)")
    return F.when(~changes, key).otherwise(let(key, rest))


def blank_store(c: Column) -> Column:
    """Whether ``normalize_store`` leaves nothing; a store made of noise alone keeps its words."""
    return _key(c) == ""


def normalize_sku(c: Column) -> Column:
    return F.when(even(c) & ~c.contains("*"), F.upper(c)).otherwise(_uneven_key(F.replace(c, F.lit("*"), F.lit(" "))))


def strip_leading_zeros(c: Column) -> Column:
    # most numbers begin and end with a sign that stays, and need no pattern
    stays = F.substring(c, 1, 1).between("1", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(stays, c).otherwise(F.regexp_replace(trim(c), r"^0+(?=[0-9])", ""))


def title_case(c: Column) -> Column:
    """Capitalise each word; one-letter words and words with digits keep their case."""
    return F.array_join(
        F.transform(
            F.split(c, " "),
            lambda t: F.when((F.length(t) <= 1) | t.rlike("[0-9]"), t).otherwise(
                F.concat(F.substring(t, 1, 1), F.lower(F.call_function("substring", t, F.lit(2))))
            ),
        ),
        " ",
    )


def present(c: Column) -> Column:
    """Non-null and not the empty string."""
    return c.isNotNull() & (c != "")
