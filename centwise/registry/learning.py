"""Dictionary, review decisions, receipt checks and reading quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise.operators import decisions, dictionary, quality, receipts
from centwise.functions.money import to_pct
from centwise.functions.text import normalize_sku, normalize_store
from centwise.registry.catalog import query
from centwise.registry.fragments import fragment
from centwise.registry.sql_engine import walk
from centwise.registry.stored import household

NOW = 1_700_000_000_000
PCTS = ["name_confidence", "category_confidence"]


def _flat(df):
    return df.select(*[to_pct(F.col(c)).alias(c) if c in PCTS else F.col(c) for c in df.columns])


def _pct_of(value: str) -> str:
    return f"CAST(floor({value} * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def _pct_sql(c: str) -> str:
    return f"{_pct_of(c)} AS {c}"


_P = ", ".join(_pct_sql(c) for c in PCTS)
_STORE = "regexp_replace(replace(upper(store), ' WHSE', ''), ' 118$', '')"
fragment("l_dict", """
SELECT ri.household_id, store, CASE source WHEN 'photo' THEN lower(sku) ELSE sku END AS sku_or_abbrev, CASE source WHEN 'photo' THEN 'human' ELSE 'auto' END AS source,
  min(raw_description) AS canonical_name, min(category_id) AS category, max(line_price_cents) AS updated_at, CAST(0.9 AS DOUBLE) AS name_confidence, CAST(0.9 AS DOUBLE) AS category_confidence
FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id WHERE category_id IS NOT NULL GROUP BY ALL""")
fragment("l_rekeyed", f"""
SELECT household_id, {_STORE} AS store, upper(sku_or_abbrev) AS sku_or_abbrev, source, canonical_name, category, updated_at, name_confidence, category_confidence FROM l_dict
QUALIFY row_number() OVER (PARTITION BY household_id, {_STORE}, upper(sku_or_abbrev) ORDER BY source DESC, updated_at DESC, l_dict.store, l_dict.sku_or_abbrev) = 1""")


@query("sku_dictionary", f"SELECT household_id, store, sku_or_abbrev, source, canonical_name, category, updated_at, {_P} FROM l_dict")
def sku_dictionary(spark, d):
    return _flat(household(spark, d, "sku_dictionary"))


@query("dictionary_rekeyed", f"SELECT household_id, store, sku_or_abbrev, source, canonical_name, category, updated_at, {_P} FROM l_rekeyed")
def dictionary_rekeyed(spark, d):
    return _flat(dictionary.rekey(household(spark, d, "sku_dictionary")))


# answers of an outside resolver, one per part name without a stored category
fragment("l_answers", f"""
SELECT ri.household_id, {_STORE} AS store, upper(sku) AS sku_or_abbrev, min(raw_description) AS canonical_name, CASE WHEN min(quantity) < 10 THEN 'sundries' ELSE 'household' END AS category,
  CAST(0.85 AS DOUBLE) AS name_confidence, CASE WHEN max(quantity) > 30 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS category_confidence
FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id WHERE category_id IS NULL AND canonical_name IS NOT NULL GROUP BY ALL""")


def _lines(spark, d):
    # a store's name is normalised once a receipt; to normalise it again changes nothing and costs little
    r = household(spark, d, "receipts").select(F.col("id").alias("receipt_id"), normalize_store(F.col("store")).alias("store"))
    return household(spark, d, "receipt_items").join(r, "receipt_id")


def _answers(spark, d):
    open_lines = _lines(spark, d).filter("category_id IS NULL AND canonical_name IS NOT NULL")
    per = open_lines.groupBy("household_id", normalize_store(F.col("store")).alias("store"), normalize_sku(F.col("sku")).alias("sku_or_abbrev")).agg(
        F.min("raw_description").alias("canonical_name"), F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))
    return per.select(
        "household_id", "store", "sku_or_abbrev", "canonical_name", F.when(F.col("lo") < 10, "sundries").otherwise("household").alias("category"),
        F.lit(0.85).alias("name_confidence"), F.when(F.col("hi") > 30, 0.9).otherwise(0.6).alias("category_confidence"),
    )


def _resolved(spark, d):
    items = _lines(spark, d).select("household_id", "id", "store", "sku", "raw_description")
    return dictionary.resolve_items(items, dictionary.rekey(household(spark, d, "sku_dictionary")), _answers(spark, d))


fragment("l_resolved", f"""
SELECT i.household_id, i.id, i.skey, i.sku2, CASE WHEN k.source IS NOT NULL THEN k.canonical_name ELSE a.canonical_name END AS canonical_name, CASE WHEN k.source IS NOT NULL THEN k.category ELSE a.category END AS category_id,
  CASE WHEN k.source IS NOT NULL THEN k.name_confidence ELSE a.name_confidence END AS name_confidence,
  CASE WHEN k.source IS NOT NULL THEN k.category_confidence WHEN a.category = 'sundries' THEN CAST(0 AS DOUBLE) ELSE a.category_confidence END AS category_confidence,
  CASE WHEN k.source IS NOT NULL THEN 'dictionary' WHEN a.category IS NOT NULL THEN 'auto' END AS resolved_by
FROM (SELECT ri.household_id, ri.id, {_STORE} AS skey, upper(sku) AS sku2 FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id) i
LEFT JOIN l_rekeyed k ON k.household_id = i.household_id AND k.store = i.skey AND k.sku_or_abbrev = i.sku2
LEFT JOIN l_answers a ON a.household_id = i.household_id AND a.store = i.skey AND a.sku_or_abbrev = i.sku2""")


@query("resolved_items", f"SELECT household_id, id, canonical_name, category_id, resolved_by, {_P} FROM l_resolved")
def resolved_items(spark, d):
    return _flat(_resolved(spark, d).drop("store", "sku", "raw_description"))


@query("resolver_work_list", "SELECT DISTINCT household_id, skey AS store, sku2 AS sku_or_abbrev FROM l_resolved WHERE resolved_by IS NULL")
def resolver_work_list(spark, d):
    return dictionary.open_keys(_lines(spark, d), household(spark, d, "sku_dictionary"), _answers(spark, d))


@query("dictionary_upserted", f"""
SELECT household_id, store, sku_or_abbrev, source, canonical_name, category, updated_at, {_P} FROM l_rekeyed
UNION ALL SELECT household_id, store, sku_or_abbrev, 'auto', canonical_name, category, {NOW}, {_P} FROM l_answers a
WHERE category <> 'sundries' AND category_confidence >= CAST(0.8 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM l_rekeyed k WHERE k.household_id = a.household_id AND k.store = a.store AND k.sku_or_abbrev = a.sku_or_abbrev)""")
def dictionary_upserted(spark, d):
    good = dictionary.confident_answers(_answers(spark, d)).withColumn("source", F.lit("auto")).withColumn("updated_at", F.lit(NOW).cast("bigint")).withColumn("seq", F.lit(1))
    return _flat(dictionary.upsert(dictionary.rekey(household(spark, d, "sku_dictionary")), good))


fragment("l_last", f"""
SELECT ri.household_id, {_STORE} AS store, upper(sku) AS sku_or_abbrev, canonical_name AS name, CASE WHEN category_confidence = 1 THEN category_id END AS person
FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id WHERE source = 'costco_digital' AND canonical_name IS NOT NULL AND store <> ''
QUALIFY row_number() OVER (PARTITION BY ri.household_id, {_STORE}, upper(sku) ORDER BY purchased_at DESC, ri.receipt_id DESC, line_no DESC) = 1""")
_GUESS = "CASE WHEN name ILIKE '%usb-c cable%' THEN 'electronics' WHEN name ILIKE '%hardcover%' THEN 'books-media' WHEN name ILIKE '%shirt%' THEN 'clothing' WHEN name ILIKE '%paper towel%' THEN 'household' ELSE 'other' END"


@query("dictionary_learned", f"""
SELECT household_id, store, sku_or_abbrev, 'auto' AS source, name AS canonical_name, coalesce(person, {_GUESS}) AS category, {NOW} AS updated_at, CAST(100 AS BIGINT) AS name_confidence,
  CASE WHEN person IS NULL THEN CAST(50 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS category_confidence
FROM l_last l WHERE NOT EXISTS (SELECT 1 FROM l_rekeyed k WHERE k.household_id = l.household_id AND k.store = l.store AND k.sku_or_abbrev = l.sku_or_abbrev AND k.source = 'human')
UNION ALL SELECT household_id, store, sku_or_abbrev, source, canonical_name, category, updated_at, {_P} FROM l_rekeyed k
WHERE source = 'human' OR NOT EXISTS (SELECT 1 FROM l_last l WHERE k.household_id = l.household_id AND k.store = l.store AND k.sku_or_abbrev = l.sku_or_abbrev)""")
def dictionary_learned(spark, d):
    return _flat(dictionary.learn_from_digital(household(spark, d, "sku_dictionary"), household(spark, d, "receipts"), household(spark, d, "receipt_items"), NOW))


# ---- review decisions
fragment("l_old", """
SELECT household_id, CASE WHEN item_type = 'unmatched_txn' AND (household_id, item_id) NOT IN (SELECT (household_id, item_id) FROM v_decisions WHERE item_type = 'missing_receipt') THEN 'missing_receipt' ELSE item_type END AS item_type, item_id FROM v_decisions""")


@query("renamed_decisions", "SELECT * FROM l_old")
def renamed_decisions(spark, d):
    return decisions.rename_unmatched(household(spark, d, "review_decisions"))


fragment("l_incoming", """
SELECT household_id, 1 AS seq, 'sku_resolution' AS item_type, id AS item_id, CASE WHEN quantity < 15 THEN 'confirm' WHEN quantity < 25 THEN 'dismiss' ELSE 'correct' END AS decision,
  CASE WHEN quantity >= 35 THEN 'edit' WHEN quantity >= 25 THEN 'pick' END AS variant, CAST(NULL AS VARCHAR) AS candidate, quantity >= 25 AND quantity < 35 AND line_no = 1 AS unknown FROM v_receipt_items
UNION ALL SELECT household_id, 1, 'flagged_receipt', id, 'confirm', NULL, NULL, false FROM v_receipts UNION ALL SELECT household_id, 2, 'flagged_receipt', id, 'dismiss', NULL, NULL, false FROM v_receipts
UNION ALL SELECT household_id, 3, 'gossip', id, 'confirm', NULL, NULL, false FROM v_receipts WHERE source = 'photo'
UNION ALL SELECT household_id, 4, 'ambiguous_match', id, CASE WHEN amount_cents > -3000 THEN 'correct' ELSE 'confirm' END, NULL, CASE WHEN amount_cents > -3000 THEN 'h-ri-' || substr(id, 4, 12) || '-3' END, false FROM v_tx
UNION ALL SELECT household_id, 5, 'missing_receipt', id, CASE WHEN direction = 'credit' THEN 'confirm' ELSE 'dismiss' END, NULL, NULL, false FROM v_tx""")
fragment("l_alone", """
SELECT i.*, CASE WHEN i.item_type = 'gossip' THEN 'invalid_item_type' END AS early, o.item_id IS NOT NULL AS before,
  CASE i.item_type WHEN 'sku_resolution' THEN CASE WHEN NOT ri.needs_review THEN 'not_queued' WHEN i.unknown THEN 'unknown_category' END
    WHEN 'flagged_receipt' THEN CASE WHEN NOT r.needs_review THEN 'not_queued' END
    WHEN 'ambiguous_match' THEN CASE WHEN i.candidate IS NOT NULL AND m.id IS NULL THEN 'candidate_mismatch' END
    WHEN 'missing_receipt' THEN CASE WHEN i.decision = 'confirm' THEN 'not_applicable' END END AS late
FROM l_incoming i LEFT JOIN l_old o USING (household_id, item_type, item_id) LEFT JOIN v_receipt_items ri ON i.item_type = 'sku_resolution' AND ri.id = i.item_id LEFT JOIN v_receipts r ON i.item_type = 'flagged_receipt' AND r.id = i.item_id
LEFT JOIN v_matches m ON m.id = i.candidate AND m.transaction_id = i.item_id AND m.status = 'pending'""")
fragment("l_outcomes", """
SELECT *, coalesce(early, CASE WHEN before OR seq > min(CASE WHEN early IS NULL AND late IS NULL AND NOT before THEN seq END) OVER (PARTITION BY household_id, item_type, item_id) THEN 'conflict' END, late, 'accepted') AS outcome FROM l_alone""")
fragment("l_ok", "SELECT * FROM l_outcomes WHERE outcome = 'accepted'")
fragment("l_winners", """
SELECT o.item_id AS transaction_id, coalesce(any_value(candidate), arg_min(m.id, {c: -m.confidence, i: m.id})) AS winner FROM l_ok o JOIN v_matches m ON m.transaction_id = o.item_id AND m.status = 'pending'
WHERE o.item_type = 'ambiguous_match' GROUP BY 1""")


def _decided(spark, d):
    def t(name):
        return household(spark, d, name)

    return decisions.apply_decisions_batch(
        t("incoming_decisions"), decisions.rename_unmatched(t("review_decisions")), t("receipt_items"), t("receipts"), t("transactions"), t("matches"),
        dictionary.rekey(t("sku_dictionary")), NOW,
    )


@query("decision_outcomes", "SELECT household_id, CAST(seq AS BIGINT) AS seq, item_type, item_id, decision, outcome FROM l_outcomes")
def decision_outcomes(spark, d):
    return _decided(spark, d).outcomes


@query("decided_receipt_items", f"""
SELECT ri.id, CASE WHEN o.variant = 'edit' THEN 'Fixed' ELSE canonical_name END AS canonical_name, CASE o.variant WHEN 'edit' THEN 'pet-care' WHEN 'pick' THEN 'groceries' ELSE category_id END AS category_id,
  CASE WHEN o.item_id IS NULL THEN needs_review ELSE false END AS needs_review,
  {_pct_of("CASE WHEN o.variant = 'edit' OR (o.decision = 'confirm' AND canonical_name IS NOT NULL) THEN CAST(1 AS DOUBLE) ELSE name_confidence END")} AS name_confidence,
  {_pct_of("CASE WHEN o.variant IS NOT NULL OR (o.decision = 'confirm' AND category_id IS NOT NULL) THEN CAST(1 AS DOUBLE) ELSE category_confidence END")} AS category_confidence
FROM v_receipt_items ri LEFT JOIN (SELECT * FROM l_ok WHERE item_type = 'sku_resolution') o ON o.item_id = ri.id""")
def decided_receipt_items(spark, d):
    return _flat(_decided(spark, d).receipt_items.select("id", "canonical_name", "category_id", "needs_review", *PCTS))


@query("decided_receipts", "SELECT r.id, needs_review AND o.item_id IS NULL AS needs_review FROM v_receipts r LEFT JOIN (SELECT * FROM l_ok WHERE item_type = 'flagged_receipt') o ON o.item_id = r.id")
def decided_receipts(spark, d):
    return _decided(spark, d).receipts.select("id", "needs_review")


@query("decided_match_rows", "SELECT m.id, m.transaction_id, CASE WHEN m.status = 'pending' AND w.winner IS NOT NULL THEN CASE WHEN m.id = w.winner THEN 'manual' ELSE 'rejected' END ELSE m.status END AS status FROM v_matches m LEFT JOIN l_winners w USING (transaction_id)")
def decided_match_rows(spark, d):
    return _decided(spark, d).matches.select("id", "transaction_id", "status")


@query("best_pending", "SELECT household_id, transaction_id, arg_min(id, {c: -confidence, i: id}) AS best FROM v_matches WHERE status = 'pending' GROUP BY ALL")
def best_pending(spark, d):
    return decisions.best_pending(household(spark, d, "matches"))


fragment("l_taught", f"""
SELECT o.household_id, {_STORE} AS store, upper(sku) AS sku_or_abbrev, CASE o.variant WHEN 'edit' THEN 'Fixed' ELSE canonical_name END AS canonical_name, CASE o.variant WHEN 'edit' THEN 'pet-care' ELSE 'groceries' END AS category,
  CASE o.variant WHEN 'edit' THEN CAST(1 AS DOUBLE) ELSE coalesce(name_confidence, CAST(0 AS DOUBLE)) END AS name_confidence
FROM l_ok o JOIN v_receipt_items ri ON ri.id = o.item_id JOIN v_receipts r ON r.id = ri.receipt_id WHERE o.variant = 'edit' OR (o.variant = 'pick' AND canonical_name IS NOT NULL)""")


@query("decided_dictionary", """
SELECT household_id, store, sku_or_abbrev, bool_or(source = 'human') AS human, count(*) AS n FROM (
  SELECT household_id, store, sku_or_abbrev, 'human' AS source FROM (SELECT DISTINCT household_id, store, sku_or_abbrev FROM l_taught)
  UNION ALL SELECT household_id, store, sku_or_abbrev, source FROM l_rekeyed k WHERE (household_id, store, sku_or_abbrev) NOT IN (SELECT (household_id, store, sku_or_abbrev) FROM l_taught)) GROUP BY ALL""")
def decided_dictionary(spark, d):
    out = _decided(spark, d).dictionary
    return out.groupBy("household_id", "store", "sku_or_abbrev").agg(F.bool_or(F.col("source") == "human").alias("human"), F.count("*").alias("n"))


# ---- receipt checks
@query("receipt_arithmetic", """
SELECT r.id, coalesce(subtotal_cents, 0) + coalesce(tax_cents, 0) AS computed_cents, coalesce(subtotal_cents, 0) + coalesce(tax_cents, 0) - total_cents AS delta_cents,
  subtotal_cents IS NOT NULL AND abs(coalesce(subtotal_cents, 0) + coalesce(tax_cents, 0) - total_cents) <= 2 AS ok, total_cents = 0 OR (source = 'photo') = (total_cents < 0) AS sign_ok FROM v_receipts r""")
def receipt_arithmetic(spark, d):
    out = receipts.check_arithmetic(household(spark, d, "receipts"), household(spark, d, "receipt_items"))
    return out.select("id", "computed_cents", "delta_cents", "ok", receipts.sign_ok(F.col("source") == "photo", F.col("total_cents")).alias("sign_ok"))


@query("item_review_flags", "SELECT id, coalesce(name_confidence < CAST(0.8 AS DOUBLE) OR category_confidence < CAST(0.8 AS DOUBLE), true) OR name_confidence IS NULL OR category_confidence IS NULL AS flagged FROM v_receipt_items")
def item_review_flags(spark, d):
    flag = receipts.item_needs_review(F.col("name_confidence"), F.col("category_confidence"), 0.8)
    return household(spark, d, "receipt_items").select("id", flag.alias("flagged"))


# ---- reading quality: what a reader saw of each receipt, back to front, with slips
fragment("l_expected", "SELECT household_id, receipt_id, line_no AS idx, CASE WHEN quantity < 45 THEN substr(sku, 2) END AS sku, lower(raw_description) AS name, category_id AS category FROM v_receipt_items")
fragment("l_actual", """
SELECT household_id, receipt_id, 100 - line_no AS idx, CASE WHEN quantity < 20 THEN '000' || substr(sku, 2) WHEN quantity < 22 THEN '9' || substr(sku, 2) END AS sku,
  CASE WHEN quantity >= 40 THEN 'smudge' ELSE raw_description END AS name, category_id AS category FROM v_receipt_items WHERE quantity < 48""")
fragment("l_text", """
WITH t AS (SELECT DISTINCT e.name AS en, lower(a.name) AS an FROM l_expected e JOIN l_actual a USING (receipt_id)),
g AS (SELECT *, list_transform(range(1, length(en)), lambda i: en[i:i+1]) AS ga, list_transform(range(1, length(an)), lambda i: an[i:i+1]) AS gb FROM t)
SELECT en, an, CASE WHEN en = an THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * coalesce(list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gb, lambda y: y = g))))), 0) / (length(en) + length(an) - 2) END AS sim FROM g""")
fragment("l_edges", r"""
SELECT e.receipt_id AS household_id, e.receipt_id || '#' || e.idx AS e_id, a.receipt_id || '##' || a.idx AS a_id, e.idx AS e_idx, a.idx AS a_idx, sim,
  coalesce(e.sku = regexp_replace(a.sku, '^0+([0-9])', '\1'), false) AS hit, a.sku AS a_sku, a.category AS a_category
FROM l_expected e JOIN l_actual a USING (receipt_id) JOIN l_text ON en = e.name AND an = lower(a.name)""")
walk("l_pair", "l_edges", "e_id", "a_id", "e_idx, CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN 0 ELSE -sim END, a_idx")
fragment("l_pairs", """
SELECT e.household_id, e.receipt_id, e.idx AS e_idx, e.sku AS e_sku, e.category AS e_category, p.a_idx, p.a_sku, p.a_category, p.sim FROM l_expected e LEFT JOIN l_pair_won p ON p.e_id = e.receipt_id || '#' || e.idx""")


def _sides(spark, d):
    ri = household(spark, d, "receipt_items")
    q, no = F.col("quantity"), F.expr("substring(sku, 2)")
    expected = ri.select("household_id", "receipt_id", F.col("line_no").alias("idx"), F.when(q < 45, no).alias("sku"), F.lower("raw_description").alias("name"), F.col("category_id").alias("category"))
    actual = ri.filter(q < 48).select(
        "household_id", "receipt_id", (100 - F.col("line_no")).alias("idx"), F.when(q < 20, F.concat(F.lit("000"), no)).when(q < 22, F.concat(F.lit("9"), no)).alias("sku"),
        F.when(q >= 40, "smudge").otherwise(F.col("raw_description")).alias("name"), F.col("category_id").alias("category"),
    )
    return actual, expected


@query("paired_items", "SELECT household_id, receipt_id, e_idx, a_idx, CAST(floor(sim * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS score_pct FROM l_pairs")
def paired_items(spark, d):
    return quality.pair_items(*_sides(spark, d)).select("household_id", "receipt_id", "e_idx", "a_idx", to_pct(F.col("score")).alias("score_pct"))


@query("extraction_grades", """
SELECT household_id, receipt_id, count(*) FILTER (a_idx IS NOT NULL AND sim >= CAST(0.85 AS DOUBLE) AND (e_category IS NULL OR e_category = a_category)) AS correct, count(*) AS total,
  count(*) FILTER (a_idx IS NOT NULL AND sim >= CAST(0.85 AS DOUBLE) AND (e_category IS NULL OR e_category = a_category)) * 100 >= count(*) * 80 AS passed FROM l_pairs GROUP BY ALL""")
def extraction_grades(spark, d):
    graded = quality.grade(quality.pair_items(*_sides(spark, d)))
    return graded.withColumn("passed", quality.passes(F.col("correct"), F.col("total")))


@query("sku_read_stats", r"""
SELECT household_id, read, with_sku, unexpected, extracted_with_sku FROM (SELECT household_id, count(*) FILTER (coalesce(regexp_replace(a_sku, '^0+([0-9])', '\1') = e_sku, false)) AS read, count(*) AS with_sku FROM l_pairs WHERE e_sku IS NOT NULL GROUP BY 1)
JOIN (SELECT household_id, count(*) FILTER ((receipt_id, regexp_replace(sku, '^0+([0-9])', '\1')) NOT IN (SELECT (receipt_id, sku) FROM l_expected WHERE sku IS NOT NULL)) AS unexpected, count(*) AS extracted_with_sku FROM l_actual WHERE sku IS NOT NULL GROUP BY 1) USING (household_id)""")
def sku_read_stats(spark, d):
    actual, expected = _sides(spark, d)
    return quality.sku_reads(quality.pair_items(actual, expected), actual, expected)


@query("even_sample", """
SELECT id, total_cents FROM (SELECT id, total_cents, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM v_receipts)
WHERE pos IN (SELECT CAST(floor(i * (n / CAST(97 AS DOUBLE))) AS BIGINT) FROM range(97) AS t(i))""")
def even_sample(spark, d):
    return quality.sample_evenly(household(spark, d, "receipts").select("id", "total_cents"), ["id"], 97)
