"""Near-duplicate lines removed by an exact set-similarity join; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centwise.storage import cut

#: Jaccard similarity of token sets in percent.
PERCENT = 80
#: Tokens are counted in this many groups, so what is kept of rarity is bounded: one small number each.
RARITY_BITS = 18
#: Rarest tokens of a line that are first looked up for their earliest holder; changes no result.
HOLDERS = 6
#: Bits of the filters for lines whose texts are needed and for ids that repeat; their size is bounded: 64 bits to a number.
FILTER_BITS = 22
#: Sets of more tokens have 128 parities, others 64.
SHORT = 16
BLANKS = "\t\n\x0b\f\r "
#: Blanks within a line that a space stands for.
ODD = "\t\x0b\f\r"
#: Where a line stands, in order.
_AT = ["doc", "line_no", "row"]


def _plain(text: Column) -> Column:
    """The text in lower case, with spaces for other blanks within lines: a split at one plain character needs no pattern."""
    whole = F.lower(F.coalesce(text, F.lit("")))
    return F.when(whole.rlike(f"[{ODD}]"), F.translate(whole, ODD, " " * len(ODD))).otherwise(whole)


def _hashes(line: Column) -> Column:
    """Hashes of the different tokens of a plain line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _lines(docs: DataFrame, row: Column, held: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, row, line_no, line) of every plain line that isn't blank, of the ``held`` documents if given; doc and row tell texts apart."""
    known = (docs if held is None else docs.where(held(_doc(docs)))).select(_doc(docs).alias("doc"), row.alias("row"), F.posexplode(F.split(_plain(docs["text"]), "\n", -1)).alias("line_no", "line"))
    return known.where(F.trim("line") != "")


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(2**63)))


def _row(docs: DataFrame) -> Column:
    """Tells texts under one doc_id, or without one, apart; equal texts are one.

    Where an id has one row only, which a filter of fixed size finds for most, it
    is 0, since eight random bytes would be shuffled with every line.
    """
    doc = _doc(docs)
    repeated = _among(docs.groupBy(doc.alias("doc")).count().where("count > 1"), "doc")
    return F.when(repeated(doc), F.xxhash64(docs["text"])).otherwise(F.lit(0).cast("bigint"))


def _rarity(docs: DataFrame) -> Callable[[Column], Column]:
    """Token hash -> 0 to 63, growing with its frequency.

    Tokens are counted over all documents in 2^RARITY_BITS groups by their hash,
    and a token's level is the logarithm of its group's count.  Any fixed order of
    tokens gives a right join; this one never takes a frequent token for a rare
    one, and its size does not grow with the data.
    """
    token = F.explode(F.split(F.replace(_plain(docs["text"]), F.lit("\n"), F.lit(" ")), " ")).alias("token")
    group = F.xxhash64("token").bitwiseAND(2**RARITY_BITS - 1).cast("int").alias("group")
    level = F.least(F.lit(63), F.floor(2 * F.log2(F.count("*")))).cast("int").alias("level")
    # a row for each 256 groups, not one for each, reaches the driver
    digits = docs.select(token).groupBy(group).agg(level).groupBy(F.shiftright("group", 8).alias("part")).agg(F.collect_list(F.struct("group", "level")).alias("held"))
    levels = [0] * 2**RARITY_BITS
    for r in digits.collect():
        for g, v in r["held"]:
            levels[g] = v
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")
    # every group has a level; that it is never null lets the codes be sorted as plain numbers
    return lambda h: F.coalesce(F.get(table, h.bitwiseAND(2**RARITY_BITS - 1).cast("int")), F.lit(0).cast("bigint"))


def line_classes(docs: DataFrame, row: Column, percent: int = PERCENT) -> DataFrame:
    """One row per distinct token set of a line: where it stands first, its size, its rarest tokens, parities of all.

    A parity counts the tokens that hash to it, modulo 2.  What two sets share
    cancels out, so they differ in as many parities as in tokens at most, however
    large they are.  Small sets have 64 (``low``), others 128 (``low`` and
    ``high``), which give 64 if their halves are added.  Of the rarest tokens 32
    bits are kept; that two share these only makes them meet.
    """
    level = _rarity(docs)
    # rare tokens first: level above the hash
    code = lambda h: F.shiftleft(level(h), 57).bitwiseOR(F.shiftrightunsigned(h, 7))
    coded = _lines(docs, row).select("doc", "line_no", "row", F.sort_array(F.transform(_hashes(F.col("line")), code)).alias("tokens"))
    n = F.size("tokens")
    # a partner has this many tokens in common at least: percent of the larger set
    prefix = n - F.ceil(n * percent / 100).cast("int") + 1
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parity = lambda tokens: F.aggregate(tokens, zero, lambda b, t: b.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))))
    all_ = F.when(n <= SHORT, parity(F.col("tokens")))
    half = lambda bit: parity(F.filter("tokens", lambda t: t.bitwiseAND(64) == bit))
    rarest = F.transform(F.slice("tokens", 1, prefix), lambda t: (t.bitwiseAND(2**32 - 1) - 2**31).cast("int"))
    sets = coded.select(
        F.xxhash64("tokens").alias("id"), F.xxhash64(F.lit(1), "tokens").alias("id2"), F.struct("doc", "line_no", "row").alias("at"), n.alias("n"), rarest.alias("rarest"),
        all_.when(n > SHORT, half(0)).alias("low"), F.when(n > SHORT, half(64)).otherwise(zero).alias("high"),
    )
    first = sets.groupBy("id", "id2").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("rarest").alias("rarest"), F.first("low").alias("low"), F.first("high").alias("high"))
    return first.select("at.doc", "at.line_no", "at.row", "n", "rarest", "low", "high")


def _entries(classes: DataFrame, size, known: Column | None = None) -> DataFrame:
    """One row for each of a class's ``size`` rarest tokens, kept small: ``line`` is the line number and whether the
    class is settled, ``set`` the set's size and the token's place, ``before`` the token before it."""
    size = F.least(size, F.size("rarest"))
    placed = F.posexplode(F.arrays_zip(F.slice("rarest", 1, size).alias("token"), F.concat(F.array(F.lit(None).cast("int")), F.slice("rarest", 1, size - 1)).alias("before")))
    line = F.shiftleft(F.col("line_no").cast("bigint"), 1) + (F.lit(0) if known is None else known.cast("bigint"))
    exploded = classes.select("doc", line.alias("line"), "row", "n", "low", "high", placed.alias("i", "t"))
    return exploded.select("t.token", "doc", "line", "row", (F.shiftleft(F.col("n").cast("bigint"), 31) + F.col("i")).alias("set"), "low", "high", "t.before")


def _could_match(x: str, y: str, percent: int) -> str:
    """Length, parity and positional filters on two entries of one token; no pair at ``percent`` fails one."""
    nx, ny, ix, iy = _n(x), _n(y), _i(x), _i(y)
    need = f"ceil({percent} * ({nx} + {ny}) / {100 + percent}D)"
    return f"""100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})
        AND if(least({nx}, {ny}) > {SHORT}, bit_count({x}.low ^ {y}.low) + bit_count({x}.high ^ {y}.high), bit_count({x}.low ^ {x}.high ^ {y}.low ^ {y}.high)) <= {nx} + {ny} - 2 * {need}
        AND 1 + least({nx} - {ix} - 1, {ny} - {iy} - 1) + least({ix}, {iy}) >= {need}"""


def _n(side: str) -> str:
    return f"shiftright({side}.set, 31)"


def _i(side: str) -> str:
    return f"({side}.set & 2147483647)"


def _earlier(x: str, y: str) -> str:
    lines = f"shiftright({x}.line, 1) < shiftright({y}.line, 1) OR (shiftright({x}.line, 1) = shiftright({y}.line, 1) AND {x}.row < {y}.row)"
    return f"({x}.doc < {y}.doc OR ({x}.doc = {y}.doc AND ({lines})))"


def _at(side: str) -> Column:
    return F.struct(F.col(f"{side}.doc").alias("doc"), F.shiftright(F.col(f"{side}.line"), 1).cast("int").alias("line_no"), F.col(f"{side}.row").alias("row"))


def _among(keys: DataFrame, *names: str) -> Callable[..., Column]:
    """A test of the columns ``names`` that holds for all of ``keys`` and few others: a bitmap of fixed size, however many keys there are."""
    slot = lambda *key: F.xxhash64(*key).bitwiseAND(2**FILTER_BITS - 1)
    own = keys.select(slot(*map(F.col, names)).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(63).cast("int"))
    # at most 2^FILTER_BITS / 64 rows
    words = own.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    bitmap = [0] * 2 ** (FILTER_BITS - 6)
    for r in words:
        bitmap[r["word"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def holds(*key: Column) -> Column:
        at = slot(*key)
        return F.call_function("getbit", F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return holds


def _jaccard(pairs: DataFrame, docs: DataFrame, row: Column, percent: int) -> DataFrame:
    """The late classes of ``pairs`` (early_at, late_at) that reach ``percent`` with their early one, on full sets."""
    ends = cut(pairs.select(F.col("early_at").alias("at")).union(pairs.select("late_at")).distinct().select("at.doc", "at.line_no", "at.row"), "line-ends")
    held, among = _among(ends, "doc"), _among(ends, "doc", "line_no")
    # the filters come before the cut into lines and before the shuffle; the join makes them exact.  Texts are shuffled, not hashes:
    # these are longer and random
    some = _lines(docs, row, held).where(among(F.col("doc"), F.col("line_no")))
    texts = cut(some.join(ends, _AT).groupBy(*_AT).agg(F.first("line").alias("line")).select(F.struct(*_AT).alias("at"), "line"), "line-texts")
    both = pairs.join(texts.toDF("early_at", "early"), "early_at").join(texts.toDF("late_at", "late"), "late_at")
    sets = both.select("late_at", _hashes(F.col("early")).alias("early"), _hashes(F.col("late")).alias("late"))
    common = F.size(F.array_intersect("early", "late"))
    return sets.where(100 * common >= percent * (F.size("early") + F.size("late") - common)).select("late_at").distinct()


def first_lines(docs: DataFrame, row: Column, percent: int = PERCENT) -> DataFrame:
    """(doc, line_no, row) of the lines that stay: first of their token set, and like no earlier line."""
    classes = cut(line_classes(docs, row, percent), "line-classes")
    # each line against the earliest holder of its rarest tokens: most copies are settled by these, without pairs of copies
    holder = F.struct("doc", "line", "row", "set", "low", "high")
    rare = _entries(classes, F.lit(HOLDERS))
    ordered = Window.partitionBy("token").orderBy("doc", "line", "row")
    first = rare.select("token", holder.alias("y"), F.first(holder).over(ordered).alias("x")).where(_earlier("x", "y")).where(_could_match("x", "y", percent))
    near = cut(first.select(_at("x").alias("early_at"), _at("y").alias("late_at")).distinct(), "line-pairs")
    settled = cut(_jaccard(near, docs, row, percent), "line-matches")
    # then whatever is left against all; a shorter line's tokens count up to the place where the pair must have met.  That condition
    # names both sides, so it stays in the join and both sides read one exchange
    marked = classes.join(settled.select("late_at.*", F.lit(True).alias("known")), _AT, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    entries = _entries(marked, F.size("rarest"), F.col("known"))
    x, y = entries.alias("x"), entries.alias("y")
    forward = F.expr(_earlier("x", "y"))
    # where the 32 bits of the tokens before are equal as well, the pair has met on those
    met = f"{_i('x')} <= least({_n('x')}, {_n('y')}) - ceil(2 * {percent} * least({_n('x')}, {_n('y')}) / {100 + percent}D)"
    shorter = f"({_n('x')} < {_n('y')} OR ({_n('x')} = {_n('y')} AND {_earlier('x', 'y')}))"
    open_ = f"NOT if({_earlier('x', 'y')}, y.line & 1 = 1, x.line & 1 = 1)"
    # the filters that most pairs fail come first
    alike = F.expr(f"x.token = y.token AND {_could_match('x', 'y', percent)} AND {shorter} AND {met} AND (x.before <> y.before OR x.before IS NULL OR y.before IS NULL) AND {open_}")
    pairs = x.join(y, alike).select(F.when(forward, _at("x")).otherwise(_at("y")).alias("early_at"), F.when(forward, _at("y")).otherwise(_at("x")).alias("late_at"))
    rest = cut(pairs.distinct().join(near, ["early_at", "late_at"], "left_anti"), "line-pairs")
    matched = settled.union(_jaccard(rest, docs, row, percent)).distinct()
    return classes.select(*_AT).join(matched.select("late_at.*"), _AT, "left_anti")


def kept_lines(docs: DataFrame, row: Column, percent: int = PERCENT) -> DataFrame:
    """(doc, row, kept): the numbers of the lines that stay in each text that keeps any."""
    return first_lines(docs, row, percent).groupBy("doc", "row").agg(F.array_sort(F.collect_set("line_no")).alias("kept"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the later of like lines removed from ``text``; other columns as given, n_chars renewed if there.

    A line is a set of tokens: what white space separates, in lower case.  A line
    is removed if an earlier line, by (doc_id, line number), has a Jaccard
    similarity of ``percent``/100 or more with it, whether that one stays or not.
    Tokens are ordered by rarity; lines meet only on tokens of their prefix, pass
    length, positional and parity filters, and are decided on full sets.

    Blank lines are left alone, and every row stays, if need be with an empty
    text.  Null texts stay null.  A null doc_id comes before all others.  Texts
    under one doc_id, or without one, are documents of their own, ordered by a
    hash of the text behind the line number; repeated rows are one document and
    stay equal.  doc_id is a whole number.  No rows give no rows.
    """
    own, doc, row, kept = _free(docs, 4)
    which = _row(docs)
    keyed = docs.withColumns({doc: _doc(docs), row: which})
    found = kept_lines(docs, which, percent).select(F.col("doc").alias(own + "d"), F.col("row").alias(own + "r"), F.col("kept").alias(kept))
    joined = keyed.join(found, (F.col(doc) == F.col(own + "d")) & (F.col(row) == F.col(own + "r")), "left")
    lines = F.split(docs["text"], "\n", -1)
    stay = F.filter(lines, lambda line, i: (F.btrim(line, F.lit(BLANKS)) == "") | F.coalesce(F.array_contains(kept, i), F.lit(False)))
    text = F.array_join(stay, "\n")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns))


def _free(docs: DataFrame, n: int) -> list[str]:
    """Column names that ``docs`` doesn't have, and that begin with none of its names."""
    longest = max(len(c) for c in docs.columns)
    return [f"_{i}" + "_" * longest for i in range(n)]


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, kept for each row of ``docs``: lines that aren't blank, and the numbers of those that stay; as ``dedup_lines``."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, i: F.when(F.btrim(line, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())
    row = _row(docs)
    given = docs.select("doc_id", _doc(docs).alias("doc"), row.alias("row"), F.size(lines).alias("n_lines"))
    found = given.join(kept_lines(docs, row, percent), ["doc", "row"], "left")
    return found.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
