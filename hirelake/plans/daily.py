"""The daily run: filter, deduplicate, score, rank, store, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hirelake.operators.dedupe import dedupe_in_run, seen_rows
from hirelake.operators.digest import digest_rows, digest_summary, report_rows, source_summary
from hirelake.operators.filters import filter_listings, filter_reasons
from hirelake.operators.ranking import rank_diverse
from hirelake.operators.scoring import score_listings
from hirelake.schema import Preferences, Profile, Vocabulary
from hirelake.session import materialize
from hirelake.store import SeenTable


@dataclass(frozen=True)
class DailyRun:
    """Results of a run.  ``scored`` is materialised unless the run was dry;
    ``counted`` holds what was counted while the batch was written."""

    raw: DataFrame
    scored: DataFrame
    top: DataFrame
    seen: DataFrame
    prefs: Preferences
    as_of: object
    ties: Sequence[Column | str]
    vocab: Vocabulary | None
    counted: dict[str, int]
    scanned_of: dict[str, int] | None = None

    def digest(self) -> DataFrame:
        return digest_rows(self.top)

    def report(self, n: int = 100) -> DataFrame:
        return report_rows(self.scored, self.top, n, self.ties)

    def summary(self) -> DataFrame:
        return digest_summary(self.counted["scanned"], self.scored, self.top, self.seen, self.as_of)

    def counters(self) -> DataFrame:
        """One row: listings scanned, kept by the filters, dropped as copies
        within the run, already stored, and new.  Scans nothing but ``scored``."""
        new = self.scored.agg(F.count(F.lit(1)).alias("new"))
        known = {n: F.lit(self.counted[n]).cast("long").alias(n) for n in ("scanned", "kept", "in_run_duplicates")}
        stored = F.lit(self.counted["kept"] - self.counted["in_run_duplicates"]).cast("long") - F.col("new")
        return new.select(*known.values(), stored.alias("stored"), "new")

    def sources(self) -> DataFrame:
        """The counts per source; from the same pass if the run knew its sources."""
        if self.scanned_of is None:
            return source_summary(self.raw)
        named = [(n, c) for n, c in sorted(self.scanned_of.items()) if c]
        text = ", ".join(f"{n}: {c}" for n, c in named)
        return self.raw.sparkSession.createDataFrame([(text,)], "source_summary string")

    def reasons(self) -> DataFrame:
        return filter_reasons(self.raw, self.prefs, self.as_of, self.vocab)


def counted_batch(
    raw: DataFrame, prefs: Preferences, as_of, order: Sequence[Column | str],
    vocab: Vocabulary | None = None, sources: Sequence[str] | None = None,
) -> tuple[DataFrame, dict[str, int], dict[str, int] | None]:
    """Filtered and deduplicated listings, written once, and what was counted
    on the way.

    ``raw`` is read by this pass alone, or once more if nothing passes.  With the names of the ``sources`` the
    listings of each are counted as well; those of others, or of none, count
    as "other".
    """
    scan, keep, once = Observation(), Observation(), Observation()
    named = list(sources or ())
    known = F.coalesce(F.col("source").isin(named), F.lit(False)) if named else F.lit(False)
    scans = [
        F.count(F.lit(1)).alias("scanned"), F.count_if(~known).alias("other"),
        *(F.count_if(F.col("source") == n).alias(f"source_{i}") for i, n in enumerate(named)),
    ]
    kept = filter_listings(raw.observe(scan, *scans), prefs, as_of, vocab).observe(keep, F.count(F.lit(1)).alias("kept"))
    batch = materialize(dedupe_in_run(kept, order).observe(once, F.count(F.lit(1)).alias("once")), "batch")
    if batch.isEmpty():
        # Spark leaves out what it finds to be empty, and what was observed there with it.
        seen, kept_rows, once_rows = raw.agg(*scans).first().asDict(), 0, 0
    else:
        seen, kept_rows, once_rows = scan.get, keep.get["kept"], once.get["once"]
    counted = {"scanned": seen["scanned"], "kept": kept_rows, "in_run_duplicates": kept_rows - once_rows}
    if sources is None:
        return batch, counted, None
    return batch, counted, {**{n: seen[f"source_{i}"] for i, n in enumerate(named)}, "other": seen["other"]}


def run_daily(
    raw: DataFrame,
    table: SeenTable,
    profile: Profile,
    prefs: Preferences,
    as_of,
    *,
    run_id: str,
    order: Sequence[Column | str],
    ties: Sequence[Column | str] = ("unique_key",),
    dry_run: bool = False,
    backfill: bool = False,
    vocab: Vocabulary | None = None,
    sources: Sequence[str] | None = None,
) -> DailyRun:
    """Run one batch of listings.

    ``order`` decides which copy of a listing counts, ``ties`` the order of
    equal scores.  A backfill scores listings again although they are stored;
    a dry run stores nothing.  Everything scored is stored, not only the top.
    A run id that is used again scores its own listings again and stores those
    it has not stored yet.  ``sources`` names the sources to be counted.

    ``raw`` is read once: filtered and deduplicated listings are written, their
    counters observed on the way, and compared with the key index of the table.
    """
    batch, counted, of_source = counted_batch(raw, prefs, as_of, order, vocab, sources)
    new = batch if backfill else table.without_stored(batch, run_id)
    scored = score_listings(new, profile, prefs, as_of, vocab)
    if dry_run:
        seen = table.read(except_run=run_id)
    else:
        # Ranking, storing and reporting all read the scored rows.
        scored = materialize(scored, "scored")
        table.append(seen_rows(table.without_stored(scored, run_id) if backfill else scored, as_of), run_id)
        seen = table.read()
    top = rank_diverse(scored, prefs.results_per_day, ties=ties, vocab=vocab)
    return DailyRun(raw, scored, top, seen, prefs, as_of, ties, vocab, counted, of_source)
