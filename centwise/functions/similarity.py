"""Character-bigram similarity (Sørensen–Dice over multisets)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from centwise.functions.text import even, let, squeeze

#: White space that ``squeeze`` would change; looked for first, since few names hold any.
UNEVEN = r"[\t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]|  |^ | $"


def comparable(c: Column) -> Column:
    return F.lower(F.when(even(c) | ~c.rlike(UNEVEN), c).otherwise(squeeze(c)))


def bigrams(normal: Column) -> Column:
    return F.when(
        F.length(normal) >= 2,
        F.transform(F.sequence(F.lit(1), F.length(normal) - 1), lambda i: F.substring(normal, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def numbered_bigrams(normal: Column) -> Column:
    """Bigrams as a set: a bigram's second and later occurrences carry their number, so that sets share what the multisets do."""
    def number(grams: Column) -> Column:
        return F.transform(grams, lambda g, i: let(i - F.array_position(grams, g) + 1, lambda n: F.when(n == 0, g).otherwise(F.concat(g, n.cast("string")))))

    return let(bigrams(normal), lambda grams: F.when(F.size(F.array_distinct(grams)) == F.size(grams), grams).otherwise(let(F.sort_array(grams), number)))


def dice_of_numbered(a: Column, b: Column, a_grams: Column, b_grams: Column) -> Column:
    """:func:`dice_of_comparable` of strings whose :func:`numbered_bigrams` are at hand."""
    return _dice(a, b, F.size(F.array_intersect(a_grams, b_grams)))


def _multiset_overlap(a: Column, b: Column) -> Column:
    """Set intersection runs in generated code and is exact unless both sides repeat a bigram."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda acc, g: acc + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))),
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def dice_of_comparable(a: Column, b: Column) -> Column:
    """Dice of two strings already passed through :func:`comparable`."""
    return _dice(a, b, _multiset_overlap(bigrams(a), bigrams(b)))


def _dice(a: Column, b: Column, shared: Column) -> Column:
    score = (F.lit(2.0) * shared) / (F.length(a) + F.length(b) - 2)
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0))
        .otherwise(score)
    )


def dice(a: Column, b: Column) -> Column:
    return dice_of_comparable(comparable(a), comparable(b))
