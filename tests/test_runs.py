import random
from collections import Counter
from datetime import date, datetime

from pyspark.sql import functions as F

from conftest import listing
from hirelake import Preferences, Profile
from hirelake.fixed import FACET_LIMITS
from hirelake.operators import browse as b
from hirelake.operators.dedupe import dedupe_in_run, filter_new, is_seen, mark_seen
from hirelake.operators.digest import source_counts, source_summary
from hirelake.operators.order import with_position
from hirelake.operators.ranking import rank_diverse, remaining_by_score
from hirelake.plans.daily import run_daily
from hirelake.plans.outputs import write_outputs
from hirelake.schema import LISTING, SEEN
from hirelake.session import fresh_path, shared_dir
from hirelake.sources import union_sources
from hirelake.store import SeenTable
from hirelake.streaming.daily_stream import start_daily_stream

AS_OF = "2026-03-10T12:00:00"
ORDER = ["title", "description"]


def test_dedupe_and_seen(spark, listings):
    rows = listings(*[dict(job_id=j, title=t, url=u) for j, t, u in (
        ("1", "b", "x"), ("1", "a", "y"), ("", "c", "u1"), ("", "d", "u1"), ("", "e", "u2"), ("2", "f", "x"))])
    first = dedupe_in_run(rows, ORDER)
    assert {(r.unique_key, r.title) for r in first.collect()} == {("s:1", "a"), ("s:u1", "c"), ("s:u2", "e"), ("s:2", "f")}
    seen = spark.createDataFrame([("s:1",), ("s:u2",), ("t:2",)], "unique_key string")
    new = filter_new(rows, seen, ORDER)
    assert {r.unique_key for r in new.collect()} == {"s:u1", "s:2"}
    assert sorted((r.unique_key, r.seen) for r in is_seen(first, seen).collect()) == [
        ("s:1", True), ("s:2", False), ("s:u1", False), ("s:u2", True)]


def test_new_listings_take_one_shuffle_per_side(spark, listings):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = spark.range(10).select(F.col("id").cast("string").alias("unique_key"))
        plan = filter_new(listings({}), seen, ORDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") == 2


def test_mark_seen(spark, listings):
    rows = listings(dict(job_id="1", description="x" * 2500), dict(job_id="2", description=""), dict(job_id="3")).withColumn("total_score", F.lit(7.5))
    seen = spark.createDataFrame([("s:3",)], "unique_key string")
    one, two = mark_seen(rows, seen, AS_OF, ORDER).orderBy("unique_key").collect()
    assert (len(one.description), two.description, one.score) == (2000, None, 7.5)
    assert one.first_seen == datetime(2026, 3, 10, 12) and list(one.asDict()) == SEEN.names
    single = mark_seen(rows.drop("total_score"), seen, AS_OF, ORDER).first()
    assert single.score is None


def walk(rows, n):
    """Greedy choice with a cap of two, then three, per company."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    taken, per = [], Counter()
    for cap in (2, 3):
        for r in rows:
            if len(taken) < n and r not in taken and per[r[1]] < cap:
                taken.append(r)
                per[r[1]] += 1
    return [r[0] for r in taken]


def test_rank_diverse_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    for n in (3, 10, 40):
        rows = [(f"k{i:03d}", rng.choice("abcde"), float(rng.randint(0, 20))) for i in range(60)]
        ranked = rank_diverse(spark.createDataFrame(rows, "unique_key string, company string, total_score double"), n).orderBy("rank").collect()
        assert [r.unique_key for r in ranked] == walk(rows, n)
        assert max(Counter(r.company for r in ranked).values()) <= 3 and [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_a_huge_company_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("unique_key"), F.lit("Acme").alias("company"), F.rand(1).alias("total_score"))
    plan = rank_diverse(rows, 5)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before


def test_remaining_by_score(spark):
    rows = [("a", 9.0), ("b", 8.0), ("b", 7.0), ("c", 6.0), ("d", 5.0)]
    df = spark.createDataFrame(rows, "unique_key string, total_score double")
    top = df.where("unique_key = 'a'")
    assert [(r.unique_key, r.total_score) for r in remaining_by_score(df, top, 2).orderBy("rank").collect()] == [("b", 8.0), ("c", 6.0)]
    assert [r.unique_key for r in remaining_by_score(df, None, 0).collect()] == ["a"]


def batch(listings, *ids, **given):
    return listings(*[dict(job_id=i, company=f"c{i}", description=f"python {i}", **given) for i in ids])


def test_daily_run(spark, listings):
    table = SeenTable(spark, fresh_path(spark, "seen"))
    prefs, profile = Preferences(results_per_day=2), Profile(skills=("python",))

    def run(rows, run_id, **options):
        return run_daily(rows, table, profile, prefs, AS_OF, run_id=run_id, order=ORDER, **options)

    dry = run(batch(listings, "1", "2", "2", "3"), "r0", dry_run=True)
    assert dry.top.count() == 2 and table.read().count() == 0
    first = run(batch(listings, "1", "2", "2", "3"), "r1")
    assert first.scored.count() == 3 and [r["rank"] for r in first.top.orderBy("rank").collect()] == [1, 2]
    assert first.summary().first().asDict() == {"shown": 2, "scanned": 4, "new": 3, "filtered_out": 1, "all_time_jobs": 3, "all_time_companies": 3}
    assert first.report().count() == 1 and first.digest().count() == 2 and first.sources().first().source_summary == "s: 4"
    folder = fresh_path(spark, "outputs")
    write_outputs(first, folder, 5)
    assert spark.read.json(f"{folder}/digest").count() == 2 and spark.read.json(f"{folder}/report").count() == 1
    assert spark.read.json(f"{folder}/summary").first().scanned == 4
    assert {r.reason: r.listings for r in first.reasons().collect()} == {"kept": 4}
    second = run(batch(listings, "3", "4"), "r2")
    assert {r.job_id for r in second.scored.collect()} == {"4"} and table.read().count() == 4
    # Repeating a run, even the whole of it, adds nothing.
    again = run(batch(listings, "3", "4"), "r2")
    assert {r.job_id for r in again.scored.collect()} == {"4"} and table.read().count() == 4
    assert run(batch(listings, "3", "4"), "r3").scored.count() == 0 and table.read().count() == 4
    # A backfill scores stored listings again and stores the unknown ones only.
    redo = run(batch(listings, "1", "5"), "r4", backfill=True)
    assert {r.job_id for r in redo.scored.collect()} == {"1", "5"} and table.read().count() == 5
    assert run(listings(dict(title="Cook")), "r5").top.count() == 0
    assert table.read(seen_from=date(2026, 3, 10), seen_to=date(2026, 3, 10)).count() == 5
    assert table.read(seen_from=date(2026, 4, 1)).count() == 0


def test_stream_equals_batch_and_survives_replay(spark, listings):
    landing, profile, prefs = fresh_path(spark, "landing"), Profile(), Preferences()
    for ids in (("1", "2"), ("2", "3"), ("4", "1", "4")):
        batch(listings, *ids).coalesce(1).write.mode("append").parquet(landing)

    def stream(table, checkpoint, on_run=None):
        raw = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(landing)
        start_daily_stream(raw, table, profile, prefs, AS_OF, order=ORDER, checkpoint=checkpoint, on_run=on_run).awaitTermination()

    table, checkpoint, tops = SeenTable(spark, fresh_path(spark, "seen")), fresh_path(spark, "check"), []
    stream(table, checkpoint, lambda run: tops.append(run.top.count()))
    whole = SeenTable(spark, fresh_path(spark, "seen"))
    run_daily(spark.read.schema(LISTING).parquet(landing), whole, profile, prefs, AS_OF, run_id="all", order=ORDER)

    def stored(t):
        return sorted((r.unique_key, r.score) for r in t.read().collect())

    assert stored(table) == stored(whole) and len(tops) == 3
    stream(table, fresh_path(spark, "check"))  # lost checkpoint: every batch again
    assert stored(table) == stored(whole)
    batch(listings, "9").coalesce(1).write.mode("append").parquet(landing)
    stream(table, checkpoint)
    assert len(stored(table)) == 5


def seen_frame(spark, *rows):
    base = dict(title="t", company="c", location="l", url="u", source="s", posted_date=None, first_seen=datetime(2026, 3, 10, 8), score=None, description=None)
    return spark.createDataFrame([tuple({**base, "unique_key": f"k{i}", **r}[n] for n in SEEN.names) for i, r in enumerate(rows)], SEEN)


def keys(df):
    return [r.unique_key for r in df.collect()]


def test_request_clean_up():
    q = b.BrowseQuery.from_params({"search": " x ", "posted_from": "2026-02-30", "posted_to": " 2026-02-01 ", "min_score": "a", "max_score": "7.5",
                                   "sort": "salary", "direction": "ASC", "page": "-3", "page_size": "9999"})
    assert (q.q, q.posted_from, q.posted_to, q.min_score, q.max_score) == ("x", None, date(2026, 2, 1), None, 7.5)
    assert (q.sort, q.direction, q.page, q.page_size) == ("posted_date", "asc", 1, 200)
    assert b.BrowseQuery.from_params({"page": "x", "page_size": 0, "direction": "up"}) == b.BrowseQuery(page_size=1)
    assert b.BrowseQuery.from_params({"min_score": 0}).min_score is None


def test_filters_of_a_request(spark):
    seen = seen_frame(
        spark, dict(title="100% Remote", posted_date=datetime(2026, 3, 1, 23, 59), score=80.0), dict(company="ACME", description="a_b"),
        dict(location="Köln", posted_date=datetime(2026, 3, 2), score=90.0, source="S"), dict(title="back\\slash", company=None, score=70.0),
    )

    def ask(**params):
        return sorted(keys(seen.where(b.condition(b.BrowseQuery.from_params(params)))))

    assert ask(q="remote") == ["k0"] and ask(search="A_B") == ["k1"] and ask(q="1%e") == ["k0"] and ask(q="k\\s") == ["k3"]
    assert ask(company="acme") == ["k1"] and ask(source="s") == ["k0", "k1", "k3"] and ask(q="zzz") == []
    assert ask(posted_from="2026-03-01", posted_to="2026-03-01") == ["k0"] and ask(posted_from="2026-03-02") == ["k2"]
    assert ask(first_seen_to="2026-03-09") == [] and len(ask(first_seen_from="2026-03-10", first_seen_to="2026-03-10")) == 4
    assert ask(min_score="80") == ["k0", "k2"] and ask(max_score="80") == ["k0", "k3"]


def test_sorting(spark):
    seen = seen_frame(
        spark, dict(company="b", posted_date=datetime(2026, 1, 1), score=5.0), dict(company="A", posted_date=None, score=None),
        dict(company="a", posted_date=datetime(2026, 1, 2), score=9.0), dict(company=None, posted_date=datetime(2026, 1, 2), score=9.0),
    )

    def order(sort, direction):
        return keys(b.sort_jobs(seen, sort, direction))

    assert order("posted_date", "desc") == ["k3", "k2", "k0", "k1"] and order("posted_date", "asc") == ["k0", "k3", "k2", "k1"]
    assert order("score", "desc") == ["k3", "k2", "k0", "k1"] and order("score", "asc") == ["k0", "k3", "k2", "k1"]
    assert order("company", "asc") == ["k3", "k2", "k1", "k0"] and order("company", "desc") == ["k0", "k2", "k1", "k3"]


def test_paging(spark, monkeypatch):
    seen = seen_frame(spark, *[dict(score=float(i * 7 % 23)) for i in range(23)])
    whole = keys(b.sort_jobs(seen, "score", "desc"))

    def pages():
        results = [b.query_jobs(seen, {"sort": "score", "page": p, "page_size": 5}) for p in range(1, 6)]
        return [k for r in results for k in keys(r.items.orderBy("position"))]

    assert pages() == whole
    beyond = b.query_jobs(seen, {"sort": "score", "page": 99, "page_size": 5})
    assert keys(beyond.items.orderBy("position")) == whole[20:]
    assert beyond.summary.first().asDict() == {"total_count": 23, "filtered_count": 23, "page_count": 5, "page": 5, "page_size": 5,
                                               "has_previous": True, "has_next": False}
    assert b.display_range(beyond.summary).first()[0] == "Showing 21-23 of 23"
    assert b.display_range(b.query_jobs(seen, {"q": "nope"}).summary).first()[0] == "No matching jobs"
    sorted_columns = []
    monkeypatch.setattr(b, "with_position", lambda df, order: sorted_columns.append(df.columns) or with_position(df, order))
    b.query_jobs(seen, {"sort": "score"})
    b.query_jobs(seen, {"sort": "title", "page": 2})
    assert [set(c) - set(b.ORDERING) for c in sorted_columns] == [{"score"}, {"title"}]


def test_positions_without_a_single_task(spark):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5003)).alias("x"))
    rows = with_position(df.repartition(7), ["x"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 5001)) and [r.x for r in rows] == sorted(r.x for r in rows)


def test_facets_stats_recent(spark):
    seen = seen_frame(
        spark, dict(company="b", first_seen=datetime(2026, 3, 10)), dict(company="A", first_seen=datetime(2026, 3, 9, 23, 59)),
        dict(company=" ", posted_date=datetime(2027, 1, 1)), dict(company=None), dict(company="b", location="x"),
    )
    values = [(r.facet, r.position, r.value) for r in b.facets(seen).orderBy("facet", "position").collect()]
    assert values == [("company", 1, "A"), ("company", 2, "b"), ("location", 1, "l"), ("location", 2, "x"), ("source", 1, "s")]
    assert [r.value for r in b.facets(seen, {**FACET_LIMITS, "company": 1}).where("facet = 'company'").collect()] == ["A"]
    assert b.stats(seen, AS_OF).first().asDict() == {"total_seen": 5, "added_today": 4, "unique_companies": 3}
    assert keys(b.recent_jobs(seen, 2)) == ["k2", "k3"] and len(keys(b.recent_jobs(seen, -5))) == 1


def test_browse_labels(spark):
    seen = seen_frame(spark, dict(title="", company=None, location="", source=None), dict(source="my-board2x", score=66.25, posted_date=datetime(2026, 1, 1, 5)))
    one, two = b.browse_items(seen).collect()
    assert (one.title_label, one.company_label, one.location_label, one.source_label) == ("Untitled role", "Unknown company", "Unknown location", "Unknown")
    assert (one.posted_label, one.first_seen_label, one.score_label, one.description_preview) == ("Unknown", "2026-03-10 08:00", "--", "")
    assert (two.source_label, two.score_label, two.score_band, two.posted_label) == ("My-Board2X", "66.2", "medium", "2026-01-01 05:00")


def test_json_bundle(spark):
    import json

    seen = seen_frame(spark, dict(company="b", score=1.0), dict(company="A", score=2.0), dict(company=None, score=3.0, title=""))
    bundle = json.loads(b.json_bundle(seen, {"sort": "score", "page_size": 2}, AS_OF).first().json)
    assert bundle["stats"] == {"total_seen": 3, "added_today": 3, "unique_companies": 2}
    assert bundle["filters"] == {"companies": ["A", "b"], "locations": ["l"], "sources": ["s"]} and bundle["db_path"] == ""
    result = bundle["result"]
    assert [i["unique_key"] for i in result["items"]] == ["k2", "k1"] and result["has_next"] is True
    assert result["items"][0]["posted_date"] is None and result["items"][0]["first_seen"] == "2026-03-10T08:00:00+00:00"
    assert "position" not in result["items"][0]
    assert result["query"] == {"q": "", "company": "", "location": "", "source": "", "posted_from": "", "posted_to": "", "first_seen_from": "",
                               "first_seen_to": "", "min_score": "", "max_score": "", "sort": "score", "direction": "desc", "page": 1, "page_size": 2}
    empty = json.loads(b.json_bundle(seen, {"q": "z\"z", "posted_from": "2026-01-01", "page": 9}, AS_OF, "s3://x").first().json)
    assert empty["result"]["items"] == [] and empty["result"]["filtered_count"] == 0 and empty["db_path"] == "s3://x"
    assert (empty["result"]["query"]["q"], empty["result"]["query"]["posted_from"], empty["result"]["query"]["page"]) == ('z"z', "2026-01-01", 1)


def test_preferences_of_a_settings_file():
    prefs = Preferences.from_mapping({"max_yoe_required": 6, "country": "US", "skills": ["a"], "email": {}, "excluded_companies": None})
    assert prefs == Preferences(max_years=6, country="US", skills=("a",))


def test_sources_together(listings):
    both = union_sources(listings(listing(source="b")), listings(listing(source="a"), listing(source="b")).drop("team"))
    assert {r.source: r.listings for r in source_counts(both).collect()} == {"a": 1, "b": 2}
    assert source_summary(both).first()[0] == "a: 1, b: 2"


def test_shared_dir_refuses_driver_local_folders_on_a_cluster(spark, monkeypatch):
    import pytest

    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x", "getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda *_: None)}))})

    with pytest.raises(RuntimeError):
        shared_dir(Remote)
    assert shared_dir(spark) == shared_dir(spark)


def stored_rows(spark, *names, at="2026-03-10"):
    return seen_frame(spark, *[dict(unique_key=n, first_seen=datetime.fromisoformat(at)) for n in names])


def test_a_stored_key_stays(spark):
    table = SeenTable(spark, fresh_path(spark, "seen"))

    def held():
        return sorted(keys(table.read()))

    table.append(stored_rows(spark, "a", "b"), "r1")
    table.append(stored_rows(spark, "c"), "r1")  # another batch under a used name
    assert held() == ["a", "b", "c"]
    table.append(stored_rows(spark, "a", "d", at="2026-04-02"), "r1")  # repeated in another month
    assert held() == ["a", "b", "c", "d"]
    table.append(stored_rows(spark), "r1")
    assert held() == ["a", "b", "c", "d"] and keys(table.read(except_run="r1")) == []
    table.append(stored_rows(spark, "x"), "r2")
    table.append(stored_rows(spark), "r1", replace=True)  # takes this run's rows only
    assert held() == ["x"]
    table.append(stored_rows(spark, "a"), "r1")
    assert held() == ["a", "x"] and keys(table.read(except_run="r2")) == ["a"]


def test_an_attempt_without_a_commit_does_not_count(spark):
    table = SeenTable(spark, fresh_path(spark, "seen"))
    table.append(stored_rows(spark, "a"), "r1")
    stored_rows(spark, "dead").withColumn("seen_month", F.lit("2026-03")).write.partitionBy("seen_month").parquet(f"{table.path}/rows/attempt=dead")
    assert keys(table.read()) == ["a"]


def test_new_checkpoints_and_second_streams_keep_what_is_stored(spark, listings):
    table, prefs, profile = SeenTable(spark, fresh_path(spark, "seen")), Preferences(), Profile()

    def stream(landing):
        raw = spark.readStream.schema(LISTING).parquet(landing)
        start_daily_stream(raw, table, profile, prefs, AS_OF, order=ORDER, checkpoint=fresh_path(spark, "check")).awaitTermination()

    for ids, expected in ((("1", "2"), 2), (("3",), 3), (("3", "4"), 4)):
        landing = fresh_path(spark, "landing")
        batch(listings, *ids).coalesce(1).write.parquet(landing)
        stream(landing)
        assert table.read().count() == expected


def test_a_key_stored_twice_flags_a_listing_once(spark):
    df = spark.createDataFrame([("a",), ("b",)], "unique_key string")
    flagged = is_seen(df, spark.createDataFrame([("a",), ("a",)], "unique_key string"))
    assert sorted((r.unique_key, r.seen) for r in flagged.collect()) == [("a", True), ("b", False)]


def test_nan_as_a_bound_matches_nothing(spark):
    seen = seen_frame(spark, dict(score=1.0), dict(score=None))
    assert keys(seen.where(b.condition(b.BrowseQuery.from_params({"max_score": "nan"})))) == []
    assert keys(seen.where(b.condition(b.BrowseQuery.from_params({"min_score": "nan"})))) == []


def test_a_browse_request_reads_its_months_only(spark):
    table = SeenTable(spark, fresh_path(spark, "seen"))
    table.append(stored_rows(spark, "a", "b"), "r1")
    table.append(stored_rows(spark, "c", at="2026-05-02"), "r2")
    asked = {"first_seen_from": "2026-05-01", "first_seen_to": "2026-05-31"}
    answer = b.query_jobs(table.read(), asked, table.matching)
    assert keys(answer.items) == ["c"] and answer.summary.first().total_count == 3
    plan = table.matching(answer.query)._jdf.queryExecution().executedPlan().toString()
    assert "seen_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
