"""Micro-batch form of the daily run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelake.operators.dedupe import dedupe_in_run, seen_rows, with_key
from hirelake.operators.filters import filter_listings
from hirelake.operators.scoring import score_listings
from hirelake.plans.daily import DailyRun, run_daily
from hirelake.schema import Preferences, Profile, Vocabulary
from hirelake.session import materialize
from hirelake.store import SeenTable


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of a streaming query, as Spark writes it into the checkpoint."""
    text = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()
    return text[0]


def unmet(listings: DataFrame, remember: timedelta) -> DataFrame:
    """Listings of a stream whose key no earlier micro-batch held, with all copies within the batch.

    Keys stand in streaming state, without their rows, until they have not come
    for ``remember``; so the state is bounded by the keys of that time.  Copies
    of a key pass its task as a flow of Arrow batches and are never gathered.
    A row passes as one column, as the cost of a key grows with the columns.
    """
    keyed = with_key(listings)
    packed = keyed.select("unique_key", F.struct(*keyed.columns).alias("row"))
    keep_ms = max(1, int(remember.total_seconds() * 1000))

    def fresh(_, copies: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        met = state.exists
        if not met:
            state.update((True,))
        state.setTimeoutDuration(keep_ms)
        for rows in copies:
            if not met:
                yield rows[["row"]]

    passed = packed.groupBy("unique_key").applyInPandasWithState(
        fresh, packed.select("row").schema, "met boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return passed.select("row.*")


def start_daily_stream(
    raw: DataFrame,
    table: SeenTable,
    profile: Profile,
    prefs: Preferences,
    as_of,
    *,
    order: Sequence[Column | str],
    checkpoint: str,
    on_run: Callable[[DailyRun], None] | None = None,
    vocab: Vocabulary | None = None,
    remember: timedelta | None = None,
    **trigger,
) -> StreamingQuery:
    """Filter, deduplicate, score and store every micro-batch of ``raw``.

    The seen table is the state: a key stored by an earlier batch is not new.
    Of it a batch reads the buckets of its own keys in the key index, cut down
    by a filter of those keys, and not the stored listings.
    The query's own id, which its checkpoint keeps, and the batch number name
    the run: a batch that is replayed after a failure adds nothing twice, and a
    query with a new checkpoint, or another query on the same table, never
    meets the runs of this one.  ``as_of`` may be a function of the batch
    number.  ``on_run`` receives ranked results.

    With a fixed ``as_of`` and no ``on_run`` the filters stand ahead of the
    batches.  A batch is cut off from the plan it comes from; ahead of it the
    age limit reaches the scan, and tests on one table's columns that table,
    before anything is joined.

    With ``remember`` the keys that pass the filters are also held in streaming
    state for that long (see ``unmet``), and what the stream repeats meanwhile
    is dropped there: it is neither written nor looked up.  The state only
    spares work; a key it has forgotten is found in the table.  It stands
    before the batches, so it needs a fixed ``as_of`` and takes no ``on_run``,
    whose counters are of whole batches.  A checkpoint keeps the choice.
    """
    ahead = not callable(as_of) and on_run is None
    if remember is not None and not ahead:
        raise ValueError("remember needs a fixed as_of and no on_run")
    if ahead:
        raw = filter_listings(raw, prefs, as_of, vocab)
    if remember is not None:
        raw = unmet(raw, remember)

    def store(batch: DataFrame, number: int) -> None:
        at = as_of(number) if callable(as_of) else as_of
        run_id = f"{_query_id(batch.sparkSession, checkpoint)}-batch-{number}"
        if on_run is not None:
            on_run(run_daily(batch, table, profile, prefs, at, run_id=run_id, order=order, vocab=vocab))
            return
        wanted = batch if ahead else filter_listings(batch, prefs, at, vocab)
        kept = materialize(dedupe_in_run(wanted, order), "batch")
        scored = score_listings(table.without_stored(kept, run_id), profile, prefs, at, vocab)
        table.append(seen_rows(scored, at), run_id)

    writer = (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    if remember is None:
        return writer.start()
    # Keys may time out at any moment, so Spark would go on with empty batches for ever.
    # The query keeps the settings it was started with.
    conf = raw.sparkSession.conf
    before = conf.get(_EMPTY_BATCHES)
    conf.set(_EMPTY_BATCHES, "false")
    try:
        return writer.start()
    finally:
        conf.set(_EMPTY_BATCHES, before)
