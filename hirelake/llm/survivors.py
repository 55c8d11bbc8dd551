"""One row of each component, chosen over the rows themselves and not over their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import carry
from hirelake.session import materialize


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; columns with a map, which have no hash, are left out."""
    return F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema if "map<" not in f.dataType.simpleString()))


def one_of_each(docs: DataFrame, rooted: DataFrame, key: str) -> DataFrame:
    """One row of ``docs`` for each root, in all its columns: the smallest id, then the smallest row hash.

    ``rooted`` holds (id, hash, root) of every row, with ``row_hash`` as hash.
    Rows without an id come after all others.  Equal rows are counted before
    anything is joined, so only rows that stay are moved, one for each root.
    """
    counted = rooted.groupBy("root", "id", "hash").agg(F.count("*").alias("rows"))
    stay = materialize(
        counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hash", "rows")).alias("s"))
        .select(F.col("root").alias("_root"), F.col("s.id").alias("_stay"), F.col("s.hash").alias("_stay_hash"),
                F.col("s.rows").alias("_rows")),
        "representatives",
    )
    rows = docs.select(carry(docs), F.col(key).alias("_id"), row_hash(docs).alias("_hash"))
    kept = rows.join(stay, F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_hash") == F.col("_stay_hash")))
    once = kept.where("_rows = 1").select("_row.*")
    if stay.where("_rows > 1").isEmpty():
        return once
    return once.union(kept.where("_rows > 1").dropDuplicates(["_root"]).select("_row.*"))
