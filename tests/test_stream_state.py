"""Keys of a stream held in its state, ahead of the seen table."""

from datetime import datetime, timedelta

import pytest
from conftest import listing

from hirelake.schema import LISTING, Preferences, Profile
from hirelake.session import fresh_path
from hirelake.store import SeenTable
from hirelake.streaming.daily_stream import start_daily_stream, unmet

ORDER = ["title", "url"]
LONG = timedelta(days=1)


class Watched(SeenTable):
    """A seen table that notes which keys are looked up, batch by batch."""

    def without_stored(self, batch, except_run=None):
        looked.append(sorted(r.unique_key for r in batch.select("unique_key").collect()))
        return super().without_stored(batch, except_run)


looked = []


@pytest.fixture
def land(spark, listings):
    """Landing folder and a function that adds one file to it."""
    folder = fresh_path(spark, "landing")
    looked.clear()

    def add(*given):
        made = listings(*[{"metadata": {"k": "v"}, **row} for row in given])
        made.coalesce(1).write.mode("append").parquet(folder)

    return folder, add


def go(spark, folder, table, checkpoint, remember=LONG, **options):
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(folder)
    start_daily_stream(
        stream, table, Profile(), Preferences(excluded_companies=("bad",)), "2026-03-10", order=ORDER,
        checkpoint=checkpoint, remember=remember, **options,
    ).awaitTermination()


def stored(table):
    return sorted((r.unique_key, r.title) for r in table.read().collect())


def job(n, title="Software Engineer", **given):
    return {"job_id": str(n), "title": title, **given}


def test_repeats_in_the_stream_are_not_looked_up(spark, land):
    folder, add = land
    table, checkpoint = Watched(spark, fresh_path(spark, "seen")), fresh_path(spark, "stream")
    add(job(1, "Software Engineer B"), job(1, "Software Engineer A"), job(2), job(9, company="Bad"))
    go(spark, folder, table, checkpoint)
    first = looked[0]
    assert len(first) == 2 and [t for _, t in stored(table)] == ["Software Engineer A", "Software Engineer"]
    # Another start of the same query knows the keys; one that was filtered out before is new.
    add(job(1, "Earlier"), job(2), job(3), job(9))
    add(job(3), job(1))
    go(spark, folder, table, checkpoint)
    second = [k for keys in looked[1:] for k in keys]
    assert len(second) == 2 and not set(second) & set(first)
    assert [k for k, _ in stored(table)] == sorted(first + second)


def test_a_new_checkpoint_falls_back_on_the_table(spark, land):
    folder, add = land
    table = Watched(spark, fresh_path(spark, "seen"))
    add(job(1), job(2))
    go(spark, folder, table, fresh_path(spark, "stream"))
    before = stored(table)
    go(spark, folder, table, fresh_path(spark, "stream"))
    assert len(looked) == 2 and looked[0] == looked[1] and stored(table) == before


def test_a_failed_batch_is_repeated(spark, land):
    """State of a batch that failed while storing is not kept, so its listings come again."""
    folder, add = land
    path, checkpoint = fresh_path(spark, "seen"), fresh_path(spark, "stream")

    class Broken(SeenTable):
        def append(self, *_, **__):
            raise OSError("lost")

    add(job(1), job(2))
    with pytest.raises(Exception, match="lost"):
        go(spark, folder, Broken(spark, path), checkpoint)
    add(job(2), job(3))
    go(spark, folder, SeenTable(spark, path), checkpoint)
    assert len(stored(SeenTable(spark, path))) == 3


def test_forgotten_keys_are_found_in_the_table(spark, land):
    folder, add = land
    table, checkpoint = Watched(spark, fresh_path(spark, "seen")), fresh_path(spark, "stream")
    add(job(1))
    add(job(2))
    go(spark, folder, table, checkpoint, remember=timedelta(milliseconds=1))
    add(job(1))
    go(spark, folder, table, checkpoint, remember=timedelta(milliseconds=1))
    assert sorted(looked[0] + looked[1]) == sorted(k for k, _ in stored(table)) and len(stored(table)) == 2
    assert {k for keys in looked[2:] for k in keys} <= {k for k, _ in stored(table)}


def test_an_empty_stream_and_null_fields(spark, land):
    folder, add = land
    table, checkpoint = Watched(spark, fresh_path(spark, "seen")), fresh_path(spark, "stream")
    add(job(9, company="Bad"))
    go(spark, folder, table, checkpoint)
    assert stored(table) == []
    add(job(1, metadata=None, yoe_required=None), job(2, yoe_required=3))
    go(spark, folder, table, checkpoint)
    assert len(stored(table)) == 2


def test_state_needs_a_fixed_time(spark, land):
    folder, add = land
    add(job(1))
    table = SeenTable(spark, fresh_path(spark, "seen"))
    stream = spark.readStream.schema(LISTING).parquet(folder)
    options = dict(order=ORDER, checkpoint=fresh_path(spark, "stream"), remember=LONG)
    with pytest.raises(ValueError):
        start_daily_stream(stream, table, Profile(), Preferences(), lambda n: "2026-03-10", **options)
    with pytest.raises(ValueError):
        start_daily_stream(stream, table, Profile(), Preferences(), "2026-03-10", on_run=print, **options)


def test_rows_pass_the_state_as_one_column(spark):
    """the cost of a key grew with the columns of its rows."""
    landing = fresh_path(spark, "landing")
    spark.createDataFrame([], LISTING).write.parquet(landing)
    passed = unmet(spark.readStream.schema(LISTING).parquet(landing), LONG)
    assert set(passed.columns) == {*LISTING.names, "unique_key"}
    plan = passed._jdf.queryExecution().analyzed().toString()
    assert " AS row#" in plan


@pytest.mark.parametrize("remember", [None, LONG])
def test_filters_stand_ahead_of_the_batches(spark, land, remember):
    folder, add = land
    table, checkpoint = Watched(spark, fresh_path(spark, "seen")), fresh_path(spark, "stream")
    old, new = datetime(2020, 1, 1), datetime(2026, 3, 9)
    add(job(1, posted_date=new), job(2, posted_date=old), job(3, company="Bad"), job(4))
    stream = spark.readStream.schema(LISTING).parquet(folder)
    query = start_daily_stream(
        stream, table, Profile(), Preferences(excluded_companies=("bad",)), "2026-03-10", order=ORDER,
        checkpoint=checkpoint, remember=remember,
    )
    query.awaitTermination()
    # The batch is cut off from this plan, so only what stands ahead of it reaches the scan.
    pushed = query._jsq.explainInternal(False).split("PushedFilters: [")[1].split("]")[0]
    assert "posted_date" in pushed
    assert looked == [["s:1", "s:4"]] and [k for k, _ in stored(table)] == ["s:1", "s:4"]
