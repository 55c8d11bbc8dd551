"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract on words.
SPACE = r"[\x20\x09-\x0D]"
#: Rows in one Arrow batch: long texts make ordinary batches too large for a Python worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows, and so the texts, that a Python worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_key(text: str | Column) -> Column:
    """Identity of a text: equal texts, equal keys; a null text counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def carry(docs: DataFrame) -> Column:
    """Whole row of ``docs`` as ``_row``, so that no column of it can clash with an operator's own."""
    return F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("_row")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
