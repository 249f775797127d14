"""Similarity join on names that never compares every pair.

Two names whose Dice score reaches the cutoff must share a bigram among the
first few of each name's bigrams, taken in any one fixed order.  Joining on
those few (household, bigram) keys gives every pair that can qualify; the exact
score then decides.  Names recur from household to household, so bigrams are
made once a name and scores once a pair of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.functions.similarity import bigrams, dice_of_comparable
from centwise.storage import cut


def _prefix_keys(name: Column, cutoff: float) -> Column:
    grams = bigrams(name)
    tagged = F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g))))
    share = cutoff / (2.0 - cutoff)
    n = F.size(grams)
    keep = n - F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int") + 1
    return F.slice(F.array_sort(tagged), F.lit(1), F.greatest(keep, F.lit(1)))


def similar_names(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """``left(household_id, left_name)`` × ``right(household_id, right_name)`` pairs scoring at least ``cutoff``.

    Names must already be in comparable form.  Returns household_id, left_name,
    right_name, sim.
    """
    a = cut(left.select("household_id", "left_name").distinct(), "left-names")
    b = cut(right.select("household_id", "right_name").distinct(), "right-names")
    same = a.join(
        b.withColumn("left_name", F.col("right_name")), ["household_id", "left_name"]
    ).select("household_id", "left_name", "right_name", F.lit(1.0).alias("sim"))

    ak = a.join(_grams(a, "left_name", cutoff), "left_name")
    bk = b.join(_grams(b, "right_name", cutoff), "right_name")
    na, nb = F.length("left_name") - 1, F.length("right_name") - 1
    near = cut(
        ak.join(bk, ["household_id", "gram"])
        .filter((F.col("left_name") != F.col("right_name")) & (F.least(na, nb) * 2 >= (na + nb) * F.lit(cutoff) - F.lit(1e-9)))
        .select("household_id", "left_name", "right_name")
        .distinct(),
        "near-names",
    )
    names = ["left_name", "right_name"]
    scored = near.select(*names).distinct().withColumn("sim", dice_of_comparable(F.col("left_name"), F.col("right_name"))).filter(F.col("sim") >= F.lit(cutoff))
    return same.unionByName(near.join(scored, names).select("household_id", *names, "sim"))


def _grams(side: DataFrame, name: str, cutoff: float) -> DataFrame:
    return side.select(name).distinct().select(name, F.explode(_prefix_keys(F.col(name), cutoff)).alias("gram"))
