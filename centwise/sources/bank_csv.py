"""Bank statement exports: preamble rows, then a header somewhere, then the lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centwise.functions.dates import to_date_any
from centwise.functions.keys import row_hash
from centwise.functions.money import amount_to_cents
from centwise.functions.receipt_lines import canonical_header
from centwise.functions.text import clean_bank_merchant, let, trim
from centwise.sources.csv_cells import csv_cells
from centwise.storage import cut

# Header spellings accepted for each column.
HEADER_WORDS = {
    "date": ["posteddate", "postdate", "transactiondate", "transdate", "date"],
    "amount": ["amount", "transactionamount", "amountusd", "debitcredit"],
    "payee": ["payee", "description", "merchant", "name", "memo"],
    "address": ["address", "location"],
    "reference": ["referencenumber", "reference", "refno", "referenceno", "ref"],
}
REQUIRED = ["date", "amount", "payee"]


def header_columns(cells: Column) -> Column:
    """Zero-based index of each logical column in a row of cells; -1 where it is absent."""
    canon = F.transform(cells, canonical_header)

    def first(words: list[str]) -> Column:
        return F.array_position(F.transform(canon, lambda c: c.isin(words)), True).cast("int") - 1

    return F.struct(*[first(words).alias(name) for name, words in HEADER_WORDS.items()])


def _may_be_header(cells: Column) -> Column:
    """False where a row cannot name all required columns: their words are not in its text. One look at a row instead of one at each cell."""
    text = canonical_header(F.array_join(cells, ""))
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [text.contains(w) for w in HEADER_WORDS[name]]) for name in REQUIRED])


def read_bank_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). Rows: file, row_no, posted_date, amount_cents, direction, raw and normalised merchant, source_row_hash."""
    # the header of a file is found first, so its rows are read twice; the text is cut into cells once
    rows = cut(csv_cells(spark, path), "bank-cells")
    width = F.size(F.filter("cells", lambda c: c.isNotNull()))
    marked = rows.select("file", "pos", F.when(let(F.col("cells"), _may_be_header), header_columns(F.col("cells"))).alias("h"))
    is_header = (F.col("h.date") >= 0) & (F.col("h.amount") >= 0) & (F.col("h.payee") >= 0)
    # written, they are found once and have a size that the planner knows: the rows need not be shuffled to meet them
    tops = cut(marked.groupBy("file").agg(F.min("pos").alias("start"), F.min(F.when(is_header, F.col("pos"))).alias("pos")), "bank-tops")
    heads = rows.join(tops.select("file", "pos"), ["file", "pos"]).select("file", F.struct("pos", header_columns(F.col("cells")).alias("h"), width.alias("width")).alias("head"))
    files = cut(tops.drop("pos").join(heads, "file", "left"), "bank-heads")
    body = rows.join(files, "file").filter(F.col("head").isNotNull() & (F.col("pos") > F.col("head.pos")))
    body = body.filter(F.exists("cells", lambda c: trim(c) != ""))

    def cell(name: str) -> Column:
        return trim(F.coalesce(F.get("cells", F.col(f"head.h.{name}")), F.lit("")))

    # as wide as the header at least, and every cell beyond it
    whole = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(0), F.col("head.width") - F.size("cells"))))
    amount, posted = amount_to_cents(cell("amount")), to_date_any(cell("date"))
    parsed = body.select(
        "file", (F.col("pos") - F.col("start") + 1).alias("row_no"), cell("date").alias("date_raw"), cell("amount").alias("amount_raw"),
        posted.alias("posted_date"), amount.alias("amount_cents"), cell("payee").alias("raw_merchant"),
        row_hash(whole).alias("source_row_hash"), F.array_join(whole, "|", "").alias("raw"),
    )
    reason = (
        F.when(F.col("date_raw") == "", "missing date").when(F.col("posted_date").isNull(), F.concat(F.lit("unparseable date: "), "date_raw"))
        .when(F.col("amount_raw") == "", "missing amount").when(F.col("amount_cents").isNull(), F.concat(F.lit("unparseable amount: "), "amount_raw"))
        .when(F.col("raw_merchant") == "", "missing payee")
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(
        "file", "row_no", "posted_date", "amount_cents", F.when(F.col("amount_cents") < 0, "debit").otherwise("credit").alias("direction"),
        "raw_merchant", clean_bank_merchant(F.col("raw_merchant")).alias("normalized_merchant"), "source_row_hash",
    )
    row_ref = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(" row "), F.col("row_no").cast("string"))
    bad = judged.filter("reason IS NOT NULL").select(F.lit("bank").alias("source"), row_ref.alias("row_ref"), "reason", "raw")
    headless = files.filter("head IS NULL").select(
        F.lit("bank").alias("source"), F.element_at(F.split("file", "/"), -1).alias("row_ref"),
        F.lit("no recognizable header row (need date, amount, and payee columns)").alias("reason"), F.lit(None).cast("string").alias("raw"),
    )
    return good, bad.unionByName(headless)
