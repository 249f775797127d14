"""How well a reading of a receipt agrees with what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.config import RECEIPT, ReceiptConfig
from centwise.functions.receipt_lines import identity_name
from centwise.functions.similarity import comparable, dice_of_numbered, numbered_bigrams
from centwise.functions.text import let, present, strip_leading_zeros
from centwise.storage import new_path


def _graded_name(c: Column, mode: str) -> Column:
    return identity_name(c) if mode == "identity" else c


def pair_items(actual: DataFrame, expected: DataFrame, mode: str = "full") -> DataFrame:
    """Expected items with the actual item each one is graded against.

    Expected items choose in order: an unclaimed item with the same number first,
    else the unclaimed item with the most similar name, the earlier on ties.
    ``actual``: household_id, receipt_id, idx, sku, name, category; ``expected``
    alike.  The lines of a receipt meet in one row and are paired there; names are
    compared only for items that are still free when no number decides.
    """
    key = ["household_id", "receipt_id"]
    keyed = F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull()

    def side(df: DataFrame, name: Column, alias: str) -> DataFrame:
        line = F.struct("idx", "sku", "name", "category", comparable(_graded_name(name, mode)).alias("text"), strip_leading_zeros(F.col("sku")).alias("no"))
        return df.filter(keyed).select(*key, line.alias(alias))

    # both sides are the lines of one printed receipt
    both = side(expected, F.col("name"), "e").unionByName(side(actual, F.coalesce("name", F.lit("")), "a"), allowMissingColumns=True).repartition(*key)
    met = both.groupBy(*key).agg(F.collect_list("e").alias("wanted"), F.collect_list("a").alias("given")).filter(F.size("wanted") > 0)

    def choice(e: Column, a: Column, miss: int, grams: Column) -> Column:
        score = dice_of_numbered(a["text"], e["text"], numbered_bigrams(a["text"]), grams)
        return let(score, lambda s: F.struct(
            F.lit(miss).alias("miss"), (-s if miss else F.lit(0.0)).alias("rank"), a["idx"].alias("a_idx"), s.alias("score"), a["sku"].alias("a_sku"), a["name"].alias("a_name"), a["category"].alias("a_category")))

    def by_name(e: Column, free: Column) -> Column:
        same = F.exists(free, lambda a: a["text"] == e["text"])
        # where a name is the same, only names of the same length can be as similar
        near = F.when(F.coalesce(same, F.lit(False)), F.filter(free, lambda a: F.length(a["text"]) == F.length(e["text"]))).otherwise(free)
        return let(near, lambda some: F.when(
            F.forall(some, lambda a: a["text"] == e["text"]), F.array_min(F.transform(some, lambda a: choice(e, a, 1, F.array().cast("array<string>"))))
        ).otherwise(let(numbered_bigrams(e["text"]), lambda grams: F.array_min(F.transform(some, lambda a: choice(e, a, 1, grams))))))

    def best(e: Column, free: Column) -> Column:
        hits = F.filter(free, lambda a: present(e["sku"]) & (a["no"] == e["no"]))
        return let(hits, lambda some: F.when(F.size(some) > 0, F.array_min(F.transform(some, lambda a: choice(e, a, 0, numbered_bigrams(e["text"]))))).otherwise(by_name(e, free)))

    def choose(won: Column, i: Column) -> Column:
        free = F.filter("given", lambda a: ~F.exists(won, lambda w: w["c"]["a_idx"] == a["idx"]))
        found = let(free, lambda some: F.array_min(F.transform(F.filter("wanted", lambda e: e["idx"] == i), lambda e: best(e, some))))
        return let(found, lambda c: F.when(c.isNotNull(), F.concat(won, F.array(F.struct(i.alias("e_idx"), c.alias("c"))))).otherwise(won))

    order = F.sort_array(F.array_distinct(F.transform("wanted", lambda e: e["idx"])))
    kind = {f.name: f.dataType.simpleString() for f in expected.schema}
    acts = {f.name: f.dataType.simpleString() for f in actual.schema}
    won_type = f"array<struct<e_idx:{kind['idx']},c:struct<miss:int,rank:double,a_idx:{acts['idx']},score:double,a_sku:{acts['sku']},a_name:{acts['name']},a_category:{acts['category']}>>>"
    paired = met.withColumn("won", F.aggregate(order, F.array().cast(won_type), choose))
    each = paired.select(*key, F.explode("wanted").alias("e"), "won").withColumn("c", F.get(F.filter("won", lambda w: w["e_idx"] == F.col("e.idx")), F.lit(0))["c"])
    found = ["a_idx", "a_sku", "a_name", "a_category", "score"]
    out = each.select(*key, *[F.col(f"e.{c}").alias(f"e_{c}") for c in ["idx", "sku", "name", "category"]], *[F.col(f"c.{c}").alias(c) for c in found])
    # a line without a household or a receipt meets no other
    alone = expected.filter(~keyed).select(*key, *[F.col(c).alias(f"e_{c}") for c in ["idx", "sku", "name", "category"]])
    return out.unionByName(alone, allowMissingColumns=True)


def grade(pairs: DataFrame, cfg: ReceiptConfig = RECEIPT) -> DataFrame:
    """Per receipt: expected items, and how many were named (and categorised, where expected) right."""
    right = F.col("a_idx").isNotNull() & (F.col("score") >= F.lit(cfg.grading_ratio)) & (F.col("e_category").isNull() | F.coalesce(F.col("e_category") == F.col("a_category"), F.lit(False)))
    return pairs.groupBy("household_id", "receipt_id").agg(F.count_if(right).alias("correct"), F.count("*").alias("total"))


def passes(correct: Column, total: Column, percent: int = RECEIPT.pass_percent) -> Column:
    return (total > 0) & (correct * 100 >= total * percent)


def sku_reads(pairs: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per household: numbers read right, expected, extracted, and extracted but expected nowhere on the receipt."""
    key = ["household_id", "receipt_id"]
    with_sku = pairs.filter("e_sku IS NOT NULL")
    right = F.coalesce(strip_leading_zeros(F.col("a_sku")) == strip_leading_zeros(F.col("e_sku")), F.lit(False))
    want = with_sku.groupBy("household_id").agg(F.count_if(right).alias("read"), F.count("*").alias("with_sku"))
    known = expected.filter("sku IS NOT NULL").select(*key, strip_leading_zeros(F.col("sku")).alias("no"), F.lit(True).alias("_known")).distinct()
    got = actual.filter("sku IS NOT NULL").withColumn("no", strip_leading_zeros(F.col("sku"))).join(known, key + ["no"], "left")
    have = got.groupBy("household_id").agg(F.count_if(F.col("_known").isNull()).alias("unexpected"), F.count("*").alias("extracted_with_sku"))
    joined = want.join(have, "household_id", "full_outer")
    return joined.select("household_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["read", "with_sku", "unexpected", "extracted_with_sku"]])


def sample_evenly(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """Rows at floor(i * n / limit) of the sorted list.

    Positions come from a range-partitioned sort and the sizes of its partitions,
    so no task sees the whole list.
    """
    if limit is None:
        return rows
    if limit <= 0:
        return rows.filter(F.lit(False))
    spark = rows.sparkSession
    path = new_path(spark, "sorted")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_start"))
    # one row per partition of the sort
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(W.partitionBy()))
    ranked = placed.join(offsets.select("_part", "_start", "_before", "_total"), "_part").withColumn("_pos", F.col("_at") - F.col("_start") + F.col("_before"))
    # position p is a sampling point when it is floor(i * step) for the i just at or above p / step
    step = F.col("_total") / F.lit(float(limit))
    i = F.ceil(F.col("_pos") / step - F.lit(1e-9)).cast("bigint")
    chosen = F.exists(F.array(i - 1, i, i + 1), lambda x: (x >= 0) & (x < limit) & (F.floor(x * step) == F.col("_pos")))
    return ranked.filter((F.col("_total") <= limit) | chosen).select(rows.columns)
