"""Key index and compaction of the seen table, and counters of a run."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirelake.operators import browse
from hirelake.operators.keyfilter import filter_bits, key_filter, may_hold
from hirelake.schema import SEEN, Preferences, Profile
from hirelake.session import fresh_path
from hirelake.store import KEY_BUCKETS, SeenTable


def rows(spark, *names, at="2026-03-10"):
    base = dict(title="t", company="c", location="l", url="u", source="s", posted_date=None, score=None, description=None,
                first_seen=datetime.fromisoformat(at))
    return spark.createDataFrame([tuple({**base, "unique_key": n}[f] for f in SEEN.names) for n in names], SEEN)


def held(df):
    return sorted(r.unique_key for r in df.collect())


@pytest.fixture
def table(spark):
    return SeenTable(spark, fresh_path(spark, "seen"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(table, kind):
    return [f for f in table.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{table.path}/{kind}").select("path").collect()
            if f.path.endswith(".parquet")]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_filter_holds_every_key_and_few_others(spark, bits):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    stored = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("k"))
    found = {r.k for r in may_hold(stored, "k", key_filter(keys, "k", bits), bits).collect()}
    assert {f"k{i}" for i in range(2000)} <= found and len(found) < 2000 + 48_000 * 2 * 2000 / bits
    assert may_hold(stored, "k", key_filter(keys.limit(0), "k", bits), bits).isEmpty()


def test_filter_size_is_bounded():
    assert filter_bits(0) == 1 << 16 and filter_bits(1 << 60) == 1 << 29 and filter_bits(100_000) >= 1_600_000


def test_a_small_batch_reads_its_buckets_and_shuffles_no_history(spark, table):
    table.append(rows(spark, *(f"k{i}" for i in range(3000))), "history")
    batch = rows(spark, "k7", "k2999", "new")
    stored = table.stored_keys(batch)
    text = plan(stored)
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "/keys" in line)
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] and "title" not in scan.split("ReadSchema")[1]
    assert "hashpartitioning(unique_key" not in text and "SortMergeJoin" not in text
    found = held(stored)
    assert {"k7", "k2999"} <= set(found) and len(found) < 20
    assert held(table.without_stored(batch)) == ["new"]
    assert held(table.without_stored(batch, except_run="history")) == ["k2999", "k7", "new"]
    assert held(table.without_stored(batch.limit(0))) == []


def test_what_is_shuffled_grows_with_the_batch(spark, table):
    """Ten times the history leaves the same few keys after the filter."""
    batch = rows(spark, *(f"k{i}" for i in range(50)))
    sizes = []
    for n, upto in enumerate((2_000, 20_000)):
        table.append(rows(spark, *(f"k{i}" for i in range(2_000 * n, upto))), f"r{n}")
        sizes.append(table.stored_keys(batch).count())
    assert sizes[0] >= 50 and sizes[1] <= sizes[0] + 40


def test_rows_of_a_table_without_an_index_count(spark, table):
    rows(spark, "old").withColumn("seen_month", F.lit("2026-03")).write.partitionBy("seen_month").parquet(f"{table.path}/rows/attempt=a1")
    entry = spark.createDataFrame([("r0", 1, False)], "run_id string, number long, replaces boolean")
    entry.write.parquet(f"{table.path}/commits/attempt=a1")
    table.append(rows(spark, "a"), "r1")
    assert held(table.without_stored(rows(spark, "old", "a", "b"))) == ["b"]
    assert table.compact(date(2026, 4, 1)) and held(table.read()) == ["a", "old"]
    assert held(table.without_stored(rows(spark, "old", "a", "b"))) == ["b"]


def test_compaction_keeps_runs_apart(spark, table):
    table.append(rows(spark, "a", "b"), "r1")
    table.append(rows(spark, "c"), "r2")
    table.append(rows(spark, "d", at="2026-04-05"), "r3")
    before = table.read()
    assert table.compact(date(2026, 4, 20)) and held(before) == held(table.read()) == ["a", "b", "c", "d"]
    assert held(table.read(except_run="r1")) == ["c", "d"]
    assert held(table.read(seen_from=date(2026, 3, 1), seen_to=date(2026, 3, 31))) == ["a", "b", "c"]
    assert held(table.without_stored(rows(spark, *"abcdef"))) == ["e", "f"]
    # A repeat adds nothing, a replacement takes the run's rows out of the rewritten part, and no other's.
    table.append(rows(spark, "a", "x"), "r1")
    assert held(table.read()) == ["a", "b", "c", "d", "x"]
    table.append(rows(spark, "y"), "r1", replace=True)
    assert held(table.read()) == ["c", "d", "y"] and held(table.without_stored(rows(spark, *"abcdxy"))) == ["a", "b", "x"]
    assert table.compact(date(2026, 4, 20)) and held(table.read()) == ["c", "d", "y"]
    assert not table.compact(date(2026, 4, 20))


def test_a_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    for n in "abc":
        table.append(rows(spark, n), n)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(SeenTable, "_commit", die)
        with pytest.raises(OSError):
            table.compact(date(2027, 1, 1))
    assert held(table.read()) == ["a", "b", "c"] and held(table.without_stored(rows(spark, "a", "z"))) == ["z"]
    assert table.compact(date(2027, 1, 1)) and held(table.read()) == ["a", "b", "c"]


def test_readers_during_a_compaction(spark, table):
    """A reader opened before the commit goes on with the old parts, and appends meanwhile stay."""
    for n in "ab":
        table.append(rows(spark, n), n)
    opened = table.read()
    commit, seen = SeenTable._commit, []

    class Busy(SeenTable):
        def _commit(self, attempt, record):
            table.append(rows(spark, "late"), "meanwhile")
            seen.append(held(table.read()))
            commit(self, attempt, record)

    assert Busy(spark, table.path).compact(date(2027, 1, 1))
    assert seen == [["a", "b", "late"]] and held(opened) == ["a", "b"] and held(table.read()) == ["a", "b", "late"]


def test_files_stay_bounded(spark, table):
    for n in range(6):
        table.append(rows(spark, f"a{n}", f"b{n}"), f"r{n}")
    many = len(files(table, "rows"))
    assert table.compact(date(2027, 1, 1))
    assert table.vacuum(datetime.now() - timedelta(days=1)) == 0 and len(files(table, "rows")) > many
    assert table.vacuum(datetime.now() + timedelta(days=2)) == 12
    assert len(files(table, "rows")) < many and len(files(table, "keys")) <= KEY_BUCKETS
    assert len(held(table.read())) == 12 and held(table.without_stored(rows(spark, "a3", "z"))) == ["z"]


def test_counters_of_a_run(spark, listings, table):
    from conftest import listing
    from hirelake.plans.daily import run_daily

    def batch(*ids):
        return listings(*[listing(job_id=i, source="x" if i < "3" else "y", company="Bad" if i == "9" else "Acme",
                                  title="Software Engineer") for i in ids])

    prefs = Preferences(excluded_companies=("bad",))
    options = dict(order=["title", "job_id"], sources=("x", "y"))
    first = run_daily(batch("1", "1", "2", "3", "9"), table, Profile(), prefs, "2026-03-10", run_id="r1", **options)
    assert first.counters().first().asDict() == {"scanned": 5, "kept": 4, "in_run_duplicates": 1, "stored": 0, "new": 3}
    assert first.sources().first()[0] == "x: 3, y: 2"
    second = run_daily(batch("1", "4"), table, Profile(), prefs, "2026-03-11", run_id="r2", order=["title", "job_id"], sources=("x",))
    assert second.counters().first().asDict() == {"scanned": 2, "kept": 2, "in_run_duplicates": 0, "stored": 1, "new": 1}
    assert second.sources().first()[0] == "other: 1, x: 1"
    none = run_daily(batch("1").limit(0), table, Profile(), prefs, "2026-03-11", run_id="r3", **options)
    assert none.counters().first().asDict() == dict.fromkeys(("scanned", "kept", "in_run_duplicates", "stored", "new"), 0)
    lost = run_daily(batch("9", "9"), table, Profile(), prefs, "2026-03-11", run_id="r4", **options)
    assert lost.counters().first().asDict() == {"scanned": 2, "kept": 0, "in_run_duplicates": 0, "stored": 0, "new": 0}
    assert lost.sources().first()[0] == "y: 2"
    # The landed listings are not needed for any counter, only for the reasons.
    assert "Scan ExistingRDD" not in plan(first.counters())


# --- kept counts ---------------------------------------------------------------


def listed(spark, *given, at="2026-03-10"):
    """Rows of (key, company, location)."""
    schema = "unique_key string, company string, location string"
    named = spark.createDataFrame(list(given), schema)
    return rows(spark, *[g[0] for g in given], at=at).drop("company", "location").join(named, "unique_key").select(*SEEN.names)


def agree(table, as_of="2026-03-10T08:00:00"):
    """Kept counts say what a scan of the rows says."""
    seen = table.read()
    assert table.stats(as_of).first() == browse.stats(seen, as_of).first()
    kept, scanned = (sorted(map(tuple, df.collect())) for df in (table.facets(), browse.facets(seen)))
    assert kept == scanned
    return table.stats(as_of).first().asDict()


def test_kept_counts_follow_appends_replays_and_replacement(spark, table):
    assert agree(table) == {"total_seen": 0, "added_today": 0, "unique_companies": 0}
    first = listed(spark, ("a", "Acme", "Oslo"), ("b", "acme", " "), ("c", None, None), ("d", "", "Oslo"))
    table.append(first, "r1")
    assert agree(table) == {"total_seen": 4, "added_today": 4, "unique_companies": 3}
    table.append(first, "r1")
    table.append(listed(spark, ("e", "Zeta", "Rome"), at="2026-04-01"), "r2")
    assert agree(table) == {"total_seen": 5, "added_today": 4, "unique_companies": 4}
    table.append(listed(spark, ("a", "Acme", "Bonn")), "r1", replace=True)
    assert agree(table) == {"total_seen": 2, "added_today": 1, "unique_companies": 2}
    assert [r.value for r in table.facets({"location": 1}).collect()] == ["Bonn"]


def test_kept_counts_follow_compaction(spark, table):
    for n, city in enumerate(("Oslo", "Rome", "Oslo")):
        table.append(listed(spark, (f"k{n}", f"c{n}", city)), f"r{n}")
    table.append(listed(spark, ("x", "gone", "gone")), "r9")
    table.append(listed(spark, ("y", "c0", "Rome")), "r9", replace=True)
    before = agree(table)
    assert table.compact(date(2026, 5, 1)) and agree(table) == before
    table.vacuum(datetime.now() + timedelta(days=2))
    assert agree(table) == before and len({f.path.split("attempt=")[1][:32] for f in files(table, "counts")}) == 1
    # Runs inside the rewritten counts can still be replaced, and rewritten again.
    table.append(listed(spark, ("z", "c7", "Bonn")), "r0", replace=True)
    assert agree(table)["unique_companies"] == 4
    assert table.compact(date(2026, 5, 1)) and agree(table)["total_seen"] == 4


def test_rows_of_a_table_without_counts_are_counted(spark, table):
    rows(spark, "old").withColumn("seen_month", F.lit("2026-03")).write.partitionBy("seen_month").parquet(f"{table.path}/rows/attempt=a1")
    entry = spark.createDataFrame([("r0", 1, False)], "run_id string, number long, replaces boolean")
    entry.write.parquet(f"{table.path}/commits/attempt=a1")
    assert agree(table)["total_seen"] == 1
    table.append(listed(spark, ("n", "new", "Rome")), "r1")
    assert agree(table)["total_seen"] == 2
    assert table.compact(date(2026, 4, 1)) and agree(table)["total_seen"] == 2


def test_kept_counts_read_no_rows(spark, table):
    table.append(listed(spark, ("a", "Acme", "Oslo")), "r1")
    for df in (table.stats("2026-03-10"), table.facets()):
        assert "/counts" in plan(df) and "/rows" not in plan(df)
    scan = next(line for line in plan(table.stats("2026-03-10")).splitlines() if "/counts" in line)
    assert "field" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_bundle_from_kept_counts(spark, table):
    table.append(listed(spark, ("a", "Acme", "Oslo"), ("b", "Beta", "Rome")), "r1")
    asked = {"q": "acme", "first_seen_from": "2026-03-01"}
    assert table.bundle(asked, "2026-03-10").first() == browse.json_bundle(table.read(), asked, "2026-03-10", table.path).first()


def test_a_crash_before_the_commit_leaves_the_counts(spark, table, monkeypatch):
    table.append(listed(spark, ("a", "Acme", "Oslo")), "r1")

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(SeenTable, "_commit", die)
        with pytest.raises(OSError):
            table.append(listed(spark, ("b", "Beta", "Rome")), "r2")
    assert agree(table) == {"total_seen": 1, "added_today": 1, "unique_companies": 1}


def test_compaction_shuffles_no_rows(spark, table):
    """a month's files are read together and written by a few tasks."""
    for run, names in (("a", "xy"), ("b", "z")):
        for day in ("2026-01-05", "2026-02-05"):
            table.append(rows(spark, *(n + day for n in names), at=day), run + day)
    commits = table._commits()
    live = table._live(commits)
    parts = [(r.attempt, r.seen_month) for r in table._rows(commits, live).select("attempt", "seen_month").distinct().collect()]
    moved = table._gathered(parts, {"2026-01": 3, "2026-02": 3}, live)
    text = plan(moved)
    assert "REBALANCE" not in text and "hashpartitioning(seen_month" not in text and "SortMergeJoin" not in text
    before = held(table.read())
    assert table.compact(date(2027, 1, 1)) and held(table.read()) == before and len(before) == 6


def test_the_rows_of_an_excepted_run_are_not_read(spark, table):
    table.append(rows(spark, *(f"k{i}" for i in range(500))), "history")
    table.append(rows(spark, "new"), "today")
    added = table.read(except_run="history")
    scan = next(line for line in plan(added).splitlines() if "FileScan parquet" in line and "/rows" in line)
    assert "dynamicpruning" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert held(added) == ["new"]
    # Rows that a compaction has taken in are still found by their run.
    table.compact(date(2030, 1, 1))
    assert held(table.read(except_run="history")) == ["new"] and len(held(table.read(except_run="today"))) == 500


def test_a_filter_is_tested_without_making_texts(spark):
    keys = spark.range(3).select(F.col("id").cast("string").alias("k"))
    places = {r.p for r in keys.select(F.pmod(F.xxhash64("k"), F.lit(1 << 16)).alias("p")).collect()}
    held_bits = set()
    for row in key_filter(keys, "k", 1 << 16).collect():
        for i, word in enumerate(row.held):
            for at, byte in enumerate((word & (1 << 64) - 1).to_bytes(8, "big")):
                held_bits |= {(row.block - 1) * 32768 + i * 64 + at * 8 + b + 1 for b in range(8) if byte >> b & 1}
    assert held_bits == places and "decode" not in plan(may_hold(keys, "k", key_filter(keys, "k", 1 << 16), 1 << 16))
