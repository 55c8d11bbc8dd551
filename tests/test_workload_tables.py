"""The listing views of the queries: rows move before their texts are made."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hirelake.operators import browse as b
from hirelake.operators import order as order_module
from hirelake.operators.order import with_position
from workload.core import LINE_ORDER, Tables, first_per

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, " \
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def tables(spark, path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    def line(order, part, supp, number, price, day):
        return (order, part, supp, number, 5.0, price, 0.0, 0.0, "N", "O", datetime(1998, 1, day))

    write("lineitem", [
        line(1, 9, 1, 1, 10.0, 1), line(1, 1, 1, 1, 20.0, 2), line(1, 1, 1, 1, 30.0, 3),  # the earliest has no part
        line(2, 1, 8, 1, 10.0, 1), line(2, 1, None, 1, 10.0, 1),  # no supplier
        line(3, 1, 1, 6, 10.0, 1), line(3, 1, 1, 6, 10.0, 1), line(4, 1, 2, 7, 10.0, 1),  # a supplier without a nation
    ], LINE)
    write("part", [(1, "blue ring", "Brand#1", "SMALL")] * 2, "p_partkey long, p_name string, p_brand string, p_type string")
    write("supplier", [(1, "S1", 1)] * 2 + [(2, "S2", 5)], "s_suppkey long, s_name string, s_nationkey int")
    write("nation", [(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int")
    write("region", [(1, "R")], "r_regionkey int, r_name string")
    return Tables(spark, path)


def test_seen_has_one_listing_a_key_and_no_text_moves(spark, tmp_path):
    """a key's first line that has a part, supplier and nation counts, also where those come twice."""
    t = tables(spark, str(tmp_path))
    got = sorted(tuple(r) for r in t.seen.select("unique_key", "title", "company", "location", "url", "score", "description").collect())
    every = first_per(t.line, ["unique_key"], LINE_ORDER)
    assert [r[0] for r in got] == ["n:1-1", "n:3-6"] == sorted(r.unique_key for r in every.collect())
    assert got[0][1:] == ("SMALL blue ring", "S1", "N, R", "https://example.org/j/1", 0.02, "Brand#1 blue ring needs 5+ years of work experience")
    assert not {"p_name", "title", "description"} & set(t.known_lines(t.lineitem).columns)


def test_position_keeps_named_columns_and_moves_rows_once(spark):
    """only the columns asked for are written, and the counts go to the rows."""
    df = spark.range(50).select("id", (-F.col("id")).alias("x"), F.lit("long text").alias("text"))
    placed = with_position(df, ["x"], keep=["id"])
    assert placed.columns == ["id", "position"]
    assert [r.id for r in placed.orderBy("position").collect()] == list(range(49, -1, -1))
    assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()


def test_positions_go_on_over_blocks(spark, monkeypatch):
    """F1 of round 4: rows are counted in small blocks, several a partition."""
    monkeypatch.setattr(order_module, "_BLOCK_BITS", 2)
    df = spark.range(60).select("id", F.pmod(F.col("id") * 7, F.lit(61)).alias("x")).repartition(3)
    rows = with_position(df, ["x"], keep=["id"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 61))
    assert [r.id for r in rows] == sorted(range(60), key=lambda i: i * 7 % 61)


def test_many_sorts_compare_texts_once(spark, monkeypatch):
    """F1 of round 4: numbers for texts and places by date give every order, and no text is sorted by."""
    start = datetime(2026, 1, 1)
    seen = [
        (f"k{i}", ["b", "B", None, "a"][i % 4], [None, "", "Zoë", "zOË x"][i // 2 % 4], "l", "s" if i % 5 else "S",
         None if i % 6 == 0 else start + timedelta(days=i % 3), None if i == 11 else start + timedelta(days=i % 2),
         None if i % 7 == 0 else float(i % 4) - 1)
        for i in range(24)
    ] + [("k3", "c", "t", "l", "s", None, start, 0.0)]
    names = ("unique_key", "company", "title", "location", "source", "posted_date", "first_seen", "score")
    types = dict.fromkeys(names, "string") | {"posted_date": "timestamp", "first_seen": "timestamp", "score": "double"}
    df = spark.createDataFrame(seen, ", ".join(f"{n} {t}" for n, t in types.items())).repartition(3)

    def by_hand(sort, direction):
        back, at = direction == "desc", {n: k for k, n in enumerate(names)}

        def value(r, c):
            x = r[at[c]]
            return (x or "").lower() if types[c] == "string" else (x is not None, x or start if c != "score" else x or 0.0)

        def known(c, rows, back):
            return sorted((r for r in rows if r[at[c]] is not None), key=lambda r: value(r, c), reverse=back) + [r for r in rows if r[at[c]] is None]

        rows = sorted(sorted(seen, key=lambda r: r[0]), key=lambda r: value(r, "company"))
        rows = sorted(rows, key=lambda r: value(r, "first_seen"), reverse=sort != "posted_date" or back)
        rows = known("posted_date", rows, sort != "posted_date" or back)
        if sort == "score":
            rows = known(sort, rows, back)
        elif sort != "posted_date":
            rows = sorted(rows, key=lambda r: value(r, sort), reverse=back)
        return [r[0] for r in rows]

    for bits, fields in ((b.LONG_BITS, b.fixed.SORT_FIELDS), (0, b.TEXTS[:2])):
        monkeypatch.setattr(b, "LONG_BITS", bits)
        ready = b.ranked(df)
        for sort in fields:
            for direction in ("asc", "desc"):
                rows, order = ready.keyed(sort, direction)
                assert [n for n, t in rows.dtypes if t == "string"] == ["unique_key"]
                assert not bits or sort not in b.TEXTS or rows.columns == ["unique_key", "place"]
                placed = with_position(b.sort_jobs(rows, sort, direction, order), order, keep=["unique_key"])
                assert [r.unique_key for r in placed.orderBy("position").collect()] == by_hand(sort, direction), (sort, direction)
