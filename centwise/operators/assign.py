"""Greedy one-to-one assignment in parallel rounds.

Walking all candidates in one total order and claiming both ends gives the same
result as this: in every round, accept each candidate that comes first at all of
its ends, drop whatever touches an accepted end, repeat.  A round is a pair of
grouped minima and two joins, whatever the size of a household; the first
candidate of each household is always accepted, so the loop ends.

Candidates may be edges between blocks of equal rows (see ``blocks``).  An edge
that comes first at both ends then pairs as many rows at once, by id, as no
rival of equal rank could claim: rows whose id is lower than the rival's next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.storage import Rounds, cut

KEY = "household_id"


def greedy_pairs(edges: DataFrame, left: str, right: str, order: list[Column], members: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Accepted rows of ``edges``; ``order`` sorts ascending and is made total by both ids.

    With ``members`` (household_id, block, id, at for the left and the right side)
    ``edges`` join blocks and hold their sizes in ``_ln`` and ``_rn``; the rows
    returned are those of single ids, without the sizes.
    """
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    columns = [c for c in edges.columns if c not in ("_ln", "_rn")]
    sized = edges if members else edges.withColumns({"_ln": F.lit(1), "_rn": F.lit(1)})
    zero = F.lit(0).cast("bigint")
    state = ["_rank", "_ln", "_rn", "_lo", "_ro", "_lh", "_rh"]
    alive = cut(sized.withColumns({"_rank": rank, "_lo": zero, "_ro": zero, "_lh": F.col(left), "_rh": F.col(right)}).select(*columns, *state), "edges")
    # rows to pair at once, and blocks whose next row has to be looked up, if there are any
    bulk, several = (bool(x) for x in alive.agg(F.bool_or(F.expr("_ln > 1 AND _rn > 1")), F.bool_or(F.expr("_ln > 1 OR _rn > 1"))).first()) if members else (False, False)
    accepted: DataFrame | None = None
    rounds = Rounds(alive.sparkSession, "round")
    while True:
        # the id of the block's first row left, not the block's own, breaks ties
        by_left = alive.groupBy(KEY, left).agg(F.min(F.struct("_rank", F.col("_rh"), F.col(right).alias("r"))).alias("b")).select(KEY, left, F.col("b.r").alias(right))
        by_right = alive.groupBy(KEY, right).agg(F.min(F.struct("_rank", F.col("_lh"), F.col(left).alias("l"))).alias("b")).select(KEY, F.col("b.l").alias(left), right)
        mutual = by_left.join(by_right, [KEY, left, right])
        mutual = cut(_at_once(mutual, alive, left, right, members), "mutual") if bulk else mutual.withColumn("_n", F.lit(1).cast("bigint"))
        won_left = mutual.select(KEY, left, F.col(right).alias("_won_right"), F.col("_n").alias("_nl"))
        won_right = mutual.select(KEY, right, F.col(left).alias("_won_left"), F.col("_n").alias("_nr"))
        labelled = alive.join(won_left, [KEY, left], "left").join(won_right, [KEY, right], "left")
        used_l, used_r = F.coalesce("_nl", F.lit(0)), F.coalesce("_nr", F.lit(0))
        taken = F.coalesce(F.col("_won_right") == F.col(right), F.lit(False))
        stays = (F.col("_lo") + used_l < F.col("_ln")) & (F.col("_ro") + used_r < F.col("_rn"))
        # an edge that is not used up is accepted and stays as well
        as_won = F.struct(F.lit(True).alias("taken"), F.col("_lo").alias("lo"), F.col("_ro").alias("ro"), used_l.alias("n"))
        as_open = F.struct(F.lit(False).alias("taken"), (F.col("_lo") + used_l).alias("lo"), (F.col("_ro") + used_r).alias("ro"), F.lit(0).cast("bigint").alias("n"))
        both = labelled.withColumn("_as", F.explode(F.when(taken & stays, F.array(as_won, as_open)).when(taken, F.array(as_won)).when(stays, F.array(as_open))))
        kept = ["_rank", "_ln", "_rn", "_lh", "_rh"]
        out = both.select(*columns, *kept, F.col("_as.lo").alias("_lo"), F.col("_as.ro").alias("_ro"), F.col("_as.n").alias("_n"), F.col("_as.taken").alias("_taken"))
        if several:
            out = _heads(out, left, right, members)
        won, alive = rounds.put(out, "_taken")
        settled = won.select(*columns, "_lo", "_ro", "_n")
        accepted = settled if accepted is None else accepted.unionByName(settled)
        if alive.isEmpty():
            return _single(accepted, columns, left, right, members) if several else accepted.select(*columns)


def _at_once(mutual: DataFrame, alive: DataFrame, left: str, right: str, members: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``mutual`` edges with the number of pairs that they make before a rival of equal rank comes first."""
    own = alive.select(KEY, left, right, F.col("_rank").alias("_first"), "_lo", "_ro", (F.col("_ln") - F.col("_lo")).alias("_lleft"), (F.col("_rn") - F.col("_ro")).alias("_rleft"))
    found = mutual.join(own, [KEY, left, right])
    bulk = found.filter("_lleft > 1 AND _rleft > 1")
    for side, (block, other, offset, head) in enumerate(((left, right, "_lo", "_lh"), (right, left, "_ro", "_rh"))):
        # rivals meet the edge at its other end; this side's rows below their next id are safe
        mine = bulk.select(KEY, F.col(other), F.col(block).alias("_block"), "_first")
        rival = alive.join(mine, [KEY, other]).filter((F.col(block) != F.col("_block")) & (F.col("_rank") == F.col("_first"))).groupBy(KEY, F.col("_block").alias("block")).agg(F.min(head).alias("_limit"))
        start = bulk.select(KEY, F.col(block).alias("block"), F.col(offset).alias("_from"))
        safe = members[side].join(rival.join(start, [KEY, "block"]), [KEY, "block"]).filter((F.col("at") >= F.col("_from")) & (F.col("id") < F.col("_limit")))
        counted = safe.groupBy(KEY, F.col("block").alias(block)).agg(F.count("*").alias(f"_safe{side}"))
        found = found.join(counted, [KEY, block], "left")
    n = F.least("_lleft", "_rleft", F.coalesce("_safe0", "_lleft"), F.coalesce("_safe1", "_rleft"))
    return found.select(KEY, left, right, n.cast("bigint").alias("_n"))


def _heads(out: DataFrame, left: str, right: str, members: tuple[DataFrame, DataFrame]) -> DataFrame:
    for block, offset, head, rows in ((left, "_lo", "_lh", members[0]), (right, "_ro", "_rh", members[1])):
        first = rows.select(KEY, F.col("block").alias(block), F.col("at").alias(offset), F.col("id").alias("_head"))
        out = out.join(first, [KEY, block, offset], "left").withColumn(head, F.coalesce("_head", head)).drop("_head")
    return out


def _single(accepted: DataFrame, columns: list[str], left: str, right: str, members: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Accepted edges between blocks as pairs of their rows, by id."""
    out = accepted.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    for block, offset, rows in ((left, "_lo", members[0]), (right, "_ro", members[1])):
        own = rows.select(KEY, F.col("block").alias(block), F.col("at").alias("_at"), F.col("id").alias("_id"))
        out = out.withColumn("_at", F.col(offset) + F.col("_i")).join(own, [KEY, block, "_at"], "left").withColumn(block, F.coalesce("_id", block)).drop("_at", "_id")
    return out.select(*columns)


def greedy_sets(candidates: DataFrame, ident: str, members: str, order: list[Column]) -> DataFrame:
    """Like :func:`greedy_pairs` where each candidate claims every id in its ``members`` array."""
    alive = cut(candidates.withColumn("_rank", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])), "sets")
    columns = candidates.columns
    accepted: DataFrame | None = None
    rounds = Rounds(alive.sparkSession, "round")
    while True:
        claims = alive.select(KEY, ident, "_rank", F.size(members).alias("_n"), F.explode(members).alias("_member"))
        best = claims.groupBy(KEY, "_member").agg(F.min(F.struct("_rank", F.col(ident).alias("i"), F.col("_n").alias("n"))).alias("b"))
        winners = (
            best.groupBy(KEY, F.col("b.i").alias(ident), F.col("b.n").alias("_n")).agg(F.count("*").alias("_first_at"))
            .filter(F.col("_first_at") == F.col("_n")).select(KEY, ident, F.lit(True).alias("_won"))
        )
        claimed = best.select(KEY, "_member", F.col("b.i").alias(ident)).join(winners, [KEY, ident]).select(KEY, "_member")
        touched = claims.join(claimed, [KEY, "_member"]).select(KEY, ident).distinct().withColumn("_touched", F.lit(True))
        labelled = alive.join(winners, [KEY, ident], "left").join(touched, [KEY, ident], "left")
        taken = F.coalesce("_won", F.lit(False))
        won, alive = rounds.put(labelled.filter(taken | F.col("_touched").isNull()).select(*columns, "_rank", taken.alias("_taken")), "_taken")
        accepted = won.select(*columns) if accepted is None else accepted.unionByName(won.select(*columns))
        if alive.isEmpty():
            return accepted
