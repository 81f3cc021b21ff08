"""Comparison of a candidate that arrives as a stream: each micro-batch against the rows of the baseline that have its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import Report, Settings
from ..plans.compare import compare
from ..sources.side import Side


def compare_stream(stream: DataFrame, base: Side, settings: Settings, on_report: Callable[[int, Report], None], checkpoint: str, trigger: dict | None = None):
    """Starts the query; on_report gets the batch number and the report of the batch against its keys' baseline rows. Returns the StreamingQuery.

    The baseline is cut down to the batch's keys by a semi-join, so vanished keys aren't judged; a batch that runs again gives its report again.
    """

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        cand = Side(df, base.keys, base.doc, settings.candidate)
        on_report(number, compare(base.lookup(cand), cand, settings))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
