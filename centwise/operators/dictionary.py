"""The learned dictionary: (household, store, sku or abbreviation) to product name and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.config import DIGITAL_SOURCE, RECEIPT, ReceiptConfig
from centwise.functions.rules import keyword_category
from centwise.functions.taxonomy import CATEGORIES, category_id_for, clamp_to_taxonomy
from centwise.functions.text import blank_store, normalize_sku, normalize_store, trim

KEY = ["household_id", "store", "sku_or_abbrev"]
VALUE = ["canonical_name", "category", "name_confidence", "category_confidence", "source", "updated_at"]


def resolve_items(items: DataFrame, dictionary: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Name and category of each item: the dictionary first, then an external table of answers.

    Adds canonical_name, category_id, both confidences and resolved_by
    (dictionary, auto or null).  An answer outside the taxonomy keeps no category
    confidence.
    """
    keyed = items.withColumn("_store", normalize_store(F.col("store"))).withColumn("_key", normalize_sku(F.coalesce("sku", "raw_description")))
    entry = dictionary.select(F.col("household_id"), F.col("store").alias("_store"), F.col("sku_or_abbrev").alias("_key"), F.struct(*VALUE).alias("_d"))
    joined = keyed.join(entry, ["household_id", "_store", "_key"], "left")
    if answers is not None:
        said = answers.select("household_id", F.col("store").alias("_store"), F.col("sku_or_abbrev").alias("_key"), F.struct("canonical_name", "category", "name_confidence", "category_confidence").alias("_a"))
        joined = joined.join(said, ["household_id", "_store", "_key"], "left")
    else:
        joined = joined.withColumn("_a", F.lit(None).cast("struct<canonical_name:string,category:string,name_confidence:double,category_confidence:double>"))
    hit, told = F.col("_d").isNotNull(), F.col("_a").isNotNull()
    known = F.col("_a.category").isin(list(CATEGORIES))
    return joined.select(
        *items.columns,
        F.when(hit, F.col("_d.canonical_name")).otherwise(F.col("_a.canonical_name")).alias("canonical_name"),
        F.when(hit, F.col("_d.category")).otherwise(F.col("_a.category")).alias("category_id"),
        F.when(hit, F.col("_d.name_confidence")).otherwise(F.col("_a.name_confidence")).alias("name_confidence"),
        F.when(hit, F.col("_d.category_confidence")).when(told & ~known, 0.0).otherwise(F.col("_a.category_confidence")).alias("category_confidence"),
        F.when(hit, "dictionary").when(told, "auto").alias("resolved_by"),
    )


def work_list(resolved: DataFrame) -> DataFrame:
    """Distinct keys that nothing resolved: what an external resolver should answer next."""
    return resolved.filter("resolved_by IS NULL").select(
        "household_id", normalize_store(F.col("store")).alias("store"), normalize_sku(F.coalesce("sku", "raw_description")).alias("sku_or_abbrev")
    ).distinct()


def open_keys(items: DataFrame, dictionary: DataFrame, answers: DataFrame) -> DataFrame:
    """``work_list`` of items resolved by the re-keyed ``dictionary`` and ``answers``.

    Only keys matter for it, so names and categories are not carried along, and no entry has to win over another.
    """
    asked = items.select("household_id", normalize_store(F.col("store")).alias("store"), normalize_sku(F.coalesce("sku", "raw_description")).alias("sku_or_abbrev"), F.lit(0).alias("known"))
    store, sku, blank = _new_key()
    held = dictionary.select("household_id", F.when(blank, F.col("store")).otherwise(store).alias("store"), F.when(blank, F.col("sku_or_abbrev")).otherwise(sku).alias("sku_or_abbrev"), F.lit(1).alias("known"))
    known = held.unionByName(answers.select(*KEY, F.lit(1).alias("known"))).dropna(subset=KEY)
    # counted in one grouping; a key that is partly null meets no entry
    return asked.unionByName(known).groupBy(*KEY).agg(F.max("known").alias("known")).filter("known = 0").select(*KEY)


def confident_answers(answers: DataFrame, cfg: ReceiptConfig = RECEIPT) -> DataFrame:
    """Answers good enough to be written back as automatic entries."""
    known = F.when(F.col("category").isin(list(CATEGORIES)), F.col("category_confidence")).otherwise(0.0)
    return answers.filter(F.least("name_confidence", known) >= F.lit(cfg.review_threshold))


def upsert(dictionary: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (with ``seq``) applied in order: a human entry overwrites, an automatic one only fills a gap."""
    held = dictionary.select(*KEY, F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("turn"), *VALUE)
    human = F.col("source") == "human"
    norm = incoming.withColumn("store", normalize_store(F.col("store"))).withColumn("sku_or_abbrev", normalize_sku(F.col("sku_or_abbrev")))
    new = norm.select(*KEY, F.when(human, 0).otherwise(2).alias("rank"), F.when(human, -F.col("seq")).otherwise(F.col("seq")).cast("bigint").alias("turn"), *VALUE)
    best = held.unionByName(new).groupBy(*KEY).agg(F.min(F.struct("rank", "turn", *VALUE)).alias("v"))
    return best.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in VALUE])


def _new_key() -> tuple[Column, Column, Column]:
    """An entry's normalised store and number, and whether it keeps its key since one of them would be empty."""
    store, sku = normalize_store(F.col("store")), normalize_sku(F.col("sku_or_abbrev"))
    # tested on the plain store: a filter on the normalised one would normalise every row once more
    return store, sku, blank_store(F.col("store")) | (sku == "")


def rekey(dictionary: DataFrame) -> DataFrame:
    """Entries moved to their normalised key; of several, the human one wins, then the newest."""
    store, sku, blank = _new_key()
    rank = F.struct(F.when(F.col("source") == "human", 0).otherwise(1).alias("r"), (-F.col("updated_at")).alias("u"), F.col("store").alias("s"), F.col("sku_or_abbrev").alias("k"), *VALUE)
    best = dictionary.filter(~blank).groupBy("household_id", store.alias("_store"), sku.alias("_sku")).agg(F.min(rank).alias("v"))
    moved = best.select("household_id", F.col("_store").alias("store"), F.col("_sku").alias("sku_or_abbrev"), *[F.col(f"v.{c}").alias(c) for c in VALUE])
    return moved.unionByName(dictionary.filter(blank).select(*KEY, *VALUE))


def learn_from_digital(dictionary: DataFrame, receipts: DataFrame, items: DataFrame, now_ms: int, cfg: ReceiptConfig = RECEIPT) -> DataFrame:
    """Re-key, then teach names printed on digital receipts: the latest name wins, human entries stay.

    The category is the one a person set, else the keyword rules' guess at a low confidence.
    """
    head = receipts.filter(F.col("source") == DIGITAL_SOURCE).select("household_id", F.col("id").alias("receipt_id"), "store", "purchased_at")
    named = items.filter(F.col("sku").isNotNull() & F.col("canonical_name").isNotNull()).withColumn("name", trim(F.col("canonical_name"))).filter("name <> ''")
    lines = named.join(head, ["household_id", "receipt_id"]).withColumn("store", normalize_store(F.col("store"))).withColumn("sku_or_abbrev", normalize_sku(F.col("sku")))
    lines = lines.filter("store <> '' AND sku_or_abbrev <> ''")
    human = F.col("category_id").isNotNull() & (F.col("category_confidence") == 1.0)
    last = lines.groupBy(*KEY).agg(F.max(F.struct("purchased_at", "receipt_id", "line_no", "name", F.when(human, F.col("category_id")).alias("by_person"))).alias("v"))
    last = last.select(*KEY, F.col("v.name").alias("name"), F.col("v.by_person").alias("by_person"))
    hits = last.select("name").distinct().withColumn("_hit", keyword_category(F.col("name")))
    guess = F.coalesce(category_id_for(clamp_to_taxonomy(F.coalesce("_hit.category", F.lit("Other")))), F.lit("other"))
    person = F.coalesce(F.col("by_person").isNotNull(), F.lit(False))
    taught = last.join(hits, "name", "left").select(
        *KEY, F.col("name").alias("canonical_name"), F.coalesce("by_person", guess).alias("category"), F.lit(1.0).alias("name_confidence"),
        F.when(person, 1.0).otherwise(cfg.bootstrap_category_confidence).alias("category_confidence"), F.lit("auto").alias("source"), F.lit(now_ms).cast("bigint").alias("updated_at"),
    )
    held = rekey(dictionary)
    rank = F.when(F.col("source") == "human", 0)
    both = held.withColumn("rank", rank.otherwise(2)).unionByName(taught.withColumn("rank", F.lit(1)))
    best = both.groupBy(*KEY).agg(F.min(F.struct("rank", *VALUE)).alias("v"))
    return best.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in VALUE])
