"""Table of model readings of photographed receipts; a reading that breaks the contract counts as unreadable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Kinds of fee a reading may name.
FEE_KINDS = ["crv", "bag", "bottle", "other"]
_FEE = "struct<kind: string, label: string, amount: bigint>"
_LINE = "struct<sku: string, rawDescription: string, quantity: double, unitPrice: bigint, linePrice: bigint, discount: bigint>"
_FIELDS = "readable boolean, store string, purchasedAt string, total bigint, tax bigint, " f"fees array<{_FEE}>, paymentHint struct<method: string, last4: string>, lineItems array<{_LINE}>"
SCHEMA = f"household_id string, image_hash string, {_FIELDS}, _corrupt string"


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """One row per image: household_id, image_hash, readable, head fields, fees and lines.

    Amounts must be whole cents, discounts not negative, fee kinds known;
    absent arrays are empty.  Anything else gives an unreadable row, never a guess.
    """
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    fees = F.coalesce("fees", F.array().cast(f"array<{_FEE.replace(': ', ':')}>"))
    lines = F.coalesce("lineItems", F.array().cast(f"array<{_LINE.replace(': ', ':')}>"))
    fee_ok = F.forall(fees, lambda f: F.coalesce(f["kind"].isin(FEE_KINDS), F.lit(False)) & f["label"].isNotNull() & f["amount"].isNotNull())
    line_ok = F.forall(
        lines,
        lambda x: x["rawDescription"].isNotNull() & x["quantity"].isNotNull() & x["linePrice"].isNotNull() & F.coalesce(x["discount"] >= 0, F.lit(False)),
    )
    sound = F.col("_corrupt").isNull() & F.col("readable").isNotNull() & fee_ok & line_ok
    good = sound & F.col("readable")
    return rows.select(
        "household_id", "image_hash", good.alias("readable"),
        *[F.when(good, F.col(c)).alias(a) for c, a in [("store", "store"), ("purchasedAt", "purchased_raw"), ("total", "total_cents"), ("tax", "tax_cents")]],
        F.when(good, F.col("paymentHint.last4")).alias("payment_last4"),
        F.when(good, fees).otherwise(F.array().cast(f"array<{_FEE.replace(': ', ':')}>")).alias("fees"),
        F.when(good, lines).otherwise(F.array().cast(f"array<{_LINE.replace(': ', ':')}>")).alias("lines"),
    )
