"""The seen table: every listing ever scored, in Parquet."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import instant
from hirelake.operators.browse import BrowseQuery, first_values, json_bundle, within_days
from hirelake.operators.keyfilter import filter_bits, key_filter, may_hold
from hirelake.schema import SEEN, SEEN_STORED

_MONTH = "yyyy-MM"
#: Folders of the key index; part of the layout, so never changed for a table.
KEY_BUCKETS = 64
#: Rows of a month that one task of a compaction rewrites.
MONTH_TASK_ROWS = 1_000_000
_WRITTEN = ("run_id string, number long, replaces boolean, keys boolean, "
            "retired array<struct<attempt:string,seen_month:string>>, retired_keys array<string>, "
            "counts boolean, retired_counts array<string>, at timestamp")
_COMMITTED = f"attempt string, {_WRITTEN}"
_KEYS = "unique_key string, origin string, attempt string, bucket int"
_COUNTS = "origin string, value string, rows long, attempt string, field string"
#: Days first seen stand beside the values of facets.
_DAY, _DAYS = "first_seen", "yyyy-MM-dd"


def _bucket():
    return F.pmod(F.xxhash64("unique_key"), F.lit(KEY_BUCKETS)).cast("int")


def _value_counts(rows: DataFrame) -> DataFrame:
    """(origin, field, value, rows) of stored rows: their facet values and days first seen, NULL included."""
    values = {n: F.col(n) for n in fixed.FACET_LIMITS} | {_DAY: F.date_format(_DAY, _DAYS)}
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in values.items()])
    exploded = rows.select("origin", F.inline(pairs))
    return exploded.groupBy("origin", "field", "value").agg(F.count("*").alias("rows"))


@dataclass(frozen=True)
class SeenTable:
    """Parquet folder of write attempts, each partitioned by the month first seen.

    An attempt has a folder of its own and counts once its commit, one small
    file, is there; what a run that died has left is never read.  A key that
    is stored stays: writing under a run's name again adds the keys the run
    has not stored yet, whatever the month, and touches no other run.  Only
    ``replace`` takes a run's earlier rows away, all of them and no others.
    The month serves pruning for date ranges; days within it are skipped by
    the files' own statistics.

    Beside the rows lies a key index, the keys alone in buckets of their hash.
    ``stored_keys`` reads the buckets of a batch and cuts them down by a filter
    of the batch's keys before anything is shuffled.  ``compact`` rewrites
    closed months and the index into one attempt, whose commit retires the
    parts it holds; until that commit nothing of it counts, and after it
    nothing of them.  Rows keep the attempt they came with as their origin, so
    a run can still be told apart and replaced.  One compaction may run at a
    time, beside any number of appends and readers.

    Each attempt also counts its facet values and days.  ``facets`` and
    ``stats`` add up the counts of the attempts that stand, so their cost
    grows with distinct values and not with listings; what was stored without
    counts is counted from its rows until a compaction takes it in.
    """

    spark: SparkSession
    path: str

    def _folder(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        return self._folder("commits", _COMMITTED)

    def _live(self, commits: DataFrame) -> DataFrame:
        """(attempt, run_id) of runs' commits that no later one of their run replaced."""
        runs = commits.where("run_id IS NOT NULL")
        last = runs.groupBy("run_id").agg(F.max(F.when(F.col("replaces"), F.col("number"))).alias("since"))
        return runs.join(last, "run_id").where("since IS NULL OR number >= since").select("attempt", "run_id")

    def _of(self, commits: DataFrame, except_run: str | None = None, only_run: str | None = None) -> DataFrame:
        live = self._live(commits)
        if except_run is not None:
            live = live.where(F.col("run_id") != except_run)
        if only_run is not None:
            live = live.where(F.col("run_id") == only_run)
        return live

    def read(
        self, except_run: str | None = None, seen_from: date | None = None, seen_to: date | None = None
    ) -> DataFrame:
        """Stored listings, without those of one run, first seen in a range of
        days.  Both limits prune partitions."""
        commits = self._commits()
        return self._rows(commits, self._of(commits, except_run), seen_from, seen_to).select(*SEEN.names)

    def matching(self, query: BrowseQuery) -> DataFrame:
        """Stored listings that a browse request can match: its range of days
        first seen prunes months."""
        return self.read(seen_from=query.first_seen_from, seen_to=query.first_seen_to)

    def _rows(self, commits: DataFrame, live: DataFrame, seen_from: date | None = None, seen_to: date | None = None) -> DataFrame:
        rows = self._folder("rows", SEEN_STORED)
        if seen_from or seen_to:
            rows = rows.where(within_days("first_seen", seen_from, seen_to))
        if seen_from:
            rows = rows.where(F.col("seen_month") >= f"{seen_from:%Y-%m}")
        if seen_to:
            rows = rows.where(F.col("seen_month") <= f"{seen_to:%Y-%m}")
        gone = commits.select(F.inline("retired"))
        rows = rows.join(self._holding(commits, live), "attempt", "left_semi").join(gone, ["attempt", "seen_month"], "left_anti")
        return self._of_origin(rows, live)

    @staticmethod
    def _holding(commits: DataFrame, live: DataFrame) -> DataFrame:
        """Attempts that can hold parts of those in ``live``: themselves, and compactions, whose parts have other origins.

        Parts of other attempts are not read: the folder's name prunes them.
        """
        return live.select("attempt").union(commits.where("run_id IS NULL").select("attempt"))

    @staticmethod
    def _of_origin(rows: DataFrame, live: DataFrame) -> DataFrame:
        rows = rows.withColumn("origin", F.coalesce("origin", "attempt"))
        return rows.join(live.select(F.col("attempt").alias("origin")), "origin", "left_semi")

    def _keys(self, commits: DataFrame, live: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """(unique_key, origin, attempt) of the key index, of some buckets only, and of rows stored without one."""
        keys = self._folder("keys", _KEYS)
        if buckets is not None:
            keys = keys.where(F.col("bucket").isin(buckets))
        gone = commits.select(F.explode("retired_keys").alias("attempt"))
        keys = keys.join(self._holding(commits, live).join(gone, "attempt", "left_anti"), "attempt", "left_semi")
        keys = self._of_origin(keys, live).select("unique_key", "origin", "attempt")
        bare = commits.where("run_id IS NOT NULL AND keys IS NULL").select("attempt").join(gone, "attempt", "left_anti")
        if bare.isEmpty():
            return keys
        rows = self._rows(commits, live.join(bare, "attempt", "left_semi"))
        return keys.union(rows.select("unique_key", "origin", "attempt"))

    def _counts(self, commits: DataFrame, live: DataFrame) -> DataFrame:
        """(origin, field, value, rows) of the kept counts, and of rows stored without them."""
        gone = commits.select(F.explode("retired_counts").alias("attempt"))
        kept = self._folder("counts", _COUNTS)
        kept = kept.join(self._holding(commits, live).join(gone, "attempt", "left_anti"), "attempt", "left_semi")
        counts = self._of_origin(kept, live).select("origin", "field", "value", "rows")
        bare = commits.where("run_id IS NOT NULL AND counts IS NULL").select("attempt").join(gone, "attempt", "left_anti")
        if bare.isEmpty():
            return counts
        rows = self._rows(commits, live.join(bare, "attempt", "left_semi"))
        return counts.unionByName(_value_counts(rows))

    def value_counts(self, except_run: str | None = None) -> DataFrame:
        """(field, value, rows): listings of each company, location and source, and of each day first seen."""
        commits = self._commits()
        counts = self._counts(commits, self._of(commits, except_run))
        return counts.groupBy("field", "value").agg(F.sum("rows").alias("rows"))

    def facets(self, limits: Mapping[str, int] = fixed.FACET_LIMITS) -> DataFrame:
        """As ``browse.facets`` of the stored listings, from the kept counts."""
        named = self.value_counts().where(F.col("field").isin(*limits))
        return first_values(named.select(F.col("field").alias("facet"), "value"), limits)

    def stats(self, as_of) -> DataFrame:
        """As ``browse.stats`` of the stored listings, from the kept counts."""
        counts = self.value_counts().where(F.col("field").isin(_DAY, "company"))
        listed = F.when(F.col("field") == _DAY, F.col("rows"))
        today = F.when(F.col("value") == F.date_format(instant(as_of), _DAYS), listed)
        return counts.agg(
            F.coalesce(F.sum(listed), F.lit(0)).alias("total_seen"),
            F.coalesce(F.sum(today), F.lit(0)).alias("added_today"),
            F.count(F.when(F.col("field") == "company", F.col("value"))).alias("unique_companies"),
        )

    def bundle(self, params: Mapping[str, Any] | None, as_of) -> DataFrame:
        """As ``browse.json_bundle`` of the stored listings: filters and stats
        from the kept counts, the page from the months that can match."""
        return json_bundle(
            self.read(), params, as_of, self.path,
            choices=self.facets(), totals=self.stats(as_of), matching=self.matching,
        )

    def stored_keys(self, batch: DataFrame, except_run: str | None = None, only_run: str | None = None) -> DataFrame:
        """Stored keys of ``batch`` (a few others may be among them), without those of one run or of one run only.

        ``batch`` is read twice, so it should be written or cheap.  Of the index
        only the buckets of its keys are scanned, and only keys that pass the
        batch's filter leave the scan: what is shuffled afterwards grows with
        the batch and not with the history.
        """
        seen = batch.agg(F.count("*").alias("rows"), F.collect_set(_bucket()).alias("buckets")).first()
        commits = self._commits()
        keys = self._keys(commits, self._of(commits, except_run, only_run), sorted(seen["buckets"])).select("unique_key")
        bits = filter_bits(seen["rows"])
        return may_hold(keys, "unique_key", key_filter(batch, "unique_key", bits), bits)

    def without_stored(self, batch: DataFrame, except_run: str | None = None) -> DataFrame:
        """Rows of ``batch`` whose key isn't stored yet."""
        return batch.join(self.stored_keys(batch, except_run), "unique_key", "left_anti")

    def append(self, rows: DataFrame, run_id: str, rebalance: bool = False, replace: bool = False) -> None:
        """Store the rows of a run; their keys must be new to other runs, see ``mark_seen``.

        Keys the run itself has stored are left alone, so a repeat adds nothing.
        A run sees one day, so its rows go straight to files.  ``rebalance``
        is for imports that span many months: rows are first brought together
        by month, large months split over several tasks.
        """
        of_run = self._commits().where(F.col("run_id") == run_id)
        number = of_run.agg(F.max("number")).first()[0]
        if number is not None and not replace:
            rows = rows.join(self.stored_keys(rows, only_run=run_id), "unique_key", "left_anti")
        stored = rows.select(*SEEN.names, F.date_format("first_seen", _MONTH).alias("seen_month"))
        if rebalance:
            stored = stored.hint("rebalance", "seen_month")
        attempt = uuid.uuid4().hex
        stored.write.partitionBy("seen_month").parquet(f"{self.path}/rows/attempt={attempt}")
        written = self.spark.read.schema(SEEN_STORED).parquet(f"{self.path}/rows/attempt={attempt}")
        written = written.withColumn("origin", F.lit(None).cast("string"))
        self._write_keys(written.select("unique_key", "origin"), attempt)
        self._write_counts(_value_counts(written), attempt)
        self._commit(attempt, (run_id, (number or 0) + 1, replace, True, None, None, True, None))

    def _write_keys(self, keys: DataFrame, attempt: str) -> None:
        keyed = keys.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
        keyed.write.partitionBy("bucket").parquet(f"{self.path}/keys/attempt={attempt}")

    def _write_counts(self, counts: DataFrame, attempt: str) -> None:
        counts.hint("rebalance", "field").write.partitionBy("field").parquet(f"{self.path}/counts/attempt={attempt}")

    def _commit(self, attempt: str, record: tuple) -> None:
        entry = self.spark.createDataFrame([(*record, datetime.now())], _WRITTEN)
        entry.coalesce(1).write.parquet(f"{self.path}/commits/attempt={attempt}")

    def compact(self, before: date) -> bool:
        """Rewrite the months before that of ``before``, the key index and the counts into one attempt; False if there is nothing to gain.

        Only months that lie in several attempts are rewritten.  A crash before
        the commit leaves files that never count, and one after it files that
        no longer do; ``vacuum`` removes the latter.
        """
        commits = self._commits()
        live = self._live(commits)
        rows = self._rows(commits, live).where(F.col("seen_month") < f"{before:%Y-%m}")
        sizes = rows.groupBy("attempt", "seen_month").agg(F.count("*").alias("rows")).collect()
        parts = [(r["attempt"], r["seen_month"]) for r in sizes]
        listed = Counter(m for _, m in parts)
        split = {m: sum(r["rows"] for r in sizes if r["seen_month"] == m) for m in sorted(listed) if listed[m] > 1}
        keys = self._keys(commits, live)
        indexed = sorted(r["attempt"] for r in keys.select("attempt").distinct().collect())
        if not split and len(indexed) < 2:
            return False
        attempt = uuid.uuid4().hex
        if split:
            self._gathered(parts, split, live).write.partitionBy("seen_month").parquet(f"{self.path}/rows/attempt={attempt}")
        self._write_keys(keys.select("unique_key", "origin"), attempt)
        self._write_counts(self._counts(commits, live), attempt)
        held = commits.where("run_id IS NOT NULL OR counts").select("attempt")
        held = held.join(commits.select(F.explode("retired_counts").alias("attempt")), "attempt", "left_anti")
        counted = sorted(r["attempt"] for r in held.collect())
        self._commit(attempt, (None, None, None, True, [p for p in parts if p[1] in split], indexed, True, counted))
        return True

    def _gathered(self, parts: list[tuple[str, str]], split: Mapping[str, int], live: DataFrame) -> DataFrame:
        """Rows of the months in ``split``, which has their numbers of rows.

        A month lies in folders of its own, so its files are read together and
        written by a few tasks: no row is shuffled.
        """
        rows = self._folder("rows", SEEN_STORED)

        def month(name: str) -> DataFrame:
            attempts = [a for a, m in parts if m == name]
            of_month = rows.where((F.col("seen_month") == name) & F.col("attempt").isin(attempts))
            return of_month.coalesce(1 + split[name] // MONTH_TASK_ROWS)

        every = reduce(DataFrame.union, [month(m) for m in split])
        return self._of_origin(every, live).select(*SEEN.names, "origin", "seen_month")

    def vacuum(self, before: datetime) -> int:
        """Delete the parts that compactions committed before that time have
        retired; returns how many parts of rows and index, their counts aside.

        Readers that were opened before such a compaction must have ended.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        old = self._commits().where(F.col("at") < F.lit(before)).select("retired", "retired_keys", "retired_counts").collect()
        folders = [f"rows/attempt={p['attempt']}/seen_month={p['seen_month']}" for r in old for p in r["retired"] or ()]
        folders += [f"keys/attempt={a}" for r in old for a in r["retired_keys"] or ()]
        counts = [f"counts/attempt={a}" for r in old for a in r["retired_counts"] or ()]

        def delete(folder: str) -> bool:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            return path.getFileSystem(conf).delete(path, True)

        for folder in counts:
            delete(folder)
        return sum(map(delete, folders))
