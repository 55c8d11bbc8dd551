"""Output files of a run."""

from __future__ import annotations

from hirelake.plans.daily import DailyRun


def write_outputs(run: DailyRun, folder: str, report_rows: int = 100) -> None:
    """Write the digest, the report and the counters of a run as JSON lines.
    All are small, top lists and single rows; null fields are written too."""
    run.digest().write.mode("overwrite").json(f"{folder}/digest", ignoreNullFields=False)
    run.report(report_rows).write.mode("overwrite").json(f"{folder}/report", ignoreNullFields=False)
    run.summary().write.mode("overwrite").json(f"{folder}/summary", ignoreNullFields=False)
    run.sources().write.mode("overwrite").json(f"{folder}/sources", ignoreNullFields=False)
