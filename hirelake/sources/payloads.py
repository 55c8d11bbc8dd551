"""Reading landed JSON payloads record by record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.schema import LISTING

BAD = "_bad"
_BRACKET = r"^[\s\x{feff}]*[{\[]"


def array_at(path: Sequence[str]) -> T.DataType:
    """Type that reaches the record array at ``path`` and keeps records as text."""
    kind: T.DataType = T.ArrayType(T.StringType())
    for name in reversed(path):
        kind = T.StructType([T.StructField(name, kind)])
    return kind


def split_records(raw: DataFrame, path: Sequence[str], schema: str) -> DataFrame:
    """One row per element of the payload's array at ``path``.

    Adds ``record_text`` and the parsed ``record``, NULL when it is broken.
    Elements are read one by one, so a broken element spoils neither its
    neighbours nor its payload; a payload that is no such array yields no rows.

    Records are parsed before they are exploded: tests on a record then stay
    above the explode and do not parse it again.
    """
    array = reduce(lambda c, n: c[n], path, F.from_json("payload", array_at(path)))
    full = T.StructType.fromDDL(schema).add(BAD, T.StringType())

    def read(text: Column) -> Column:
        # Only an object or array can hold a record; a failing parse costs far more than this test.
        record = F.when(text.rlike(_BRACKET), F.from_json(text, full, {"columnNameOfCorruptRecord": BAD}))
        return F.struct(text.alias("record_text"), record.alias("record"))

    others = [c for c in raw.columns if c != "payload"]
    rows = raw.select(*others, F.inline(F.transform(array, read)))
    good = F.col("record").isNotNull() & F.col(f"record.{BAD}").isNull()
    return rows.withColumn("record_ok", good)


def good_and_rejected(raw: DataFrame, path: Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Records that parse, and the texts of those that do not."""
    rows = split_records(raw, path, schema)
    good = rows.where("record_ok").drop("record_ok", "record_text")
    return good, rows.where("NOT record_ok").drop("record_ok", "record")


def good_records(raw: DataFrame, path: Sequence[str], schema: str) -> DataFrame:
    return good_and_rejected(raw, path, schema)[0]


def filled(*values: Column, default: str = "") -> Column:
    """First value that is neither NULL nor blank text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def present(*values: Column, default: str = "") -> Column:
    """First value that is not NULL; blank text counts as a value."""
    return F.coalesce(*values, F.lit(default))


def text_map(**values: Column) -> Column:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def computed_once(value: Column) -> Column:
    """``value`` for a select list, as the one element a generator yields.

    Filters on the new column stay above the generator instead of repeating
    its work below, and filters on other columns pass beneath it, so that rows
    they drop never get there.
    """
    return F.explode(F.array(value))


def as_listings(df: DataFrame, *extra: Column | str, **columns: Column) -> DataFrame:
    """Select the listing columns; the ones not given take their defaults.
    ``extra`` columns follow.  The description, the one long text to clean, is
    computed once, after the filters on other columns."""
    defaults = {
        "posted_date": F.lit(None), "yoe_required": F.lit(None),
        "metadata": F.create_map().cast("map<string,string>"),
    }
    values = {
        f.name: columns.get(f.name, defaults.get(f.name, F.lit(""))).cast(f.dataType)
        for f in LISTING.fields
    }
    values["description"] = computed_once(values["description"])
    return df.select(*[value.alias(name) for name, value in values.items()], *extra)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources' listings in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
