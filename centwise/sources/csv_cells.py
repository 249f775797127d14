"""Delimited files as rows of cells, however wide a row is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centwise.functions.text import let

#: Cells of a record at most; the reader sets up one slot for each.
MOST_CELLS = 1 << 20
_BLANK = r"[\x00-\x20&&[^\r\n]]*+"


def csv_cells(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """(file, pos, cells) of every row; no header is assumed, and no cell is cut off.

    The reader finds the records, which may hold quoted line breaks, and hands
    each over whole; its cells are cut in place, so one wide record widens no other
    and the file is read once.  One file is one task; positions follow file order.
    Empty cells, quoted or not, are null.  Rows end at their last cell that isn't
    null.
    """
    # a record of more cells than the schema counts as corrupt and is kept as it stands
    rows = (
        spark.read.option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("maxCharsPerColumn", -1).option("maxColumns", MOST_CELLS)
        .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("columnNameOfCorruptRecord", "record").schema("only string, record string").csv(path)
    )
    cells = F.when(F.col("record").isNull(), F.array("only")).otherwise(record_cells(F.col("record"), trim))
    mark = chr(0xFEFF)
    clean = F.transform(cells, lambda c: F.when(c.startswith(mark), F.substr(c, F.lit(2))).otherwise(c))
    kept = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), clean.alias("cells"))
    empty_end = let(F.reverse("cells"), lambda back: F.coalesce(F.array_position(F.transform(back, lambda c: c.isNotNull()), True).cast("int"), F.lit(0)))
    return kept.withColumn("cells", let(empty_end, lambda p: F.when(p == 0, F.slice("cells", 1, 0)).otherwise(F.slice("cells", F.lit(1), F.size("cells") - p + 1))))


def record_cells(record: Column, trim: bool = True) -> Column:
    """Cells of one record: quoted ones without their quotes, others trimmed if asked; empty ones null."""
    around = _BLANK if trim else ""
    quoted = rf'{around}"[^"]*+(?:""[^"]*+)*+"{around}(?=,|\z)'
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(record, r"[\r\n]+\z", "")), F.lit(f",(?:{quoted}|[^,]*+)"), F.lit(0))

    def value(part: Column) -> Column:
        body = F.substr(part, F.lit(2))
        plain = F.regexp_replace(body, r"^[\x00-\x20]++|[\x00-\x20]++\z", "") if trim else body
        inside = F.replace(F.regexp_extract(body, rf'(?s)^{around}"(.*)"{around}\z', 1), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(body.contains('"') & body.rlike(rf"^{quoted}\z"), inside).otherwise(plain), F.lit(""))

    return F.transform(parts, value)
