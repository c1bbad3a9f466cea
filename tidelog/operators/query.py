"""Filters over `log_events`."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import search_key, status_class

# Widths of the selectable time ranges, in minutes.
RANGE_MINUTES = {"15M": 15, "1H": 60, "6H": 6 * 60, "24H": 24 * 60}


@dataclass(frozen=True)
class LogQuery:
    """All parts are optional and combined with AND; an empty list means all."""

    text: str = ""
    methods: tuple[str, ...] = ()
    status_classes: tuple[str, ...] = ()
    log_types: tuple[str, ...] = ()
    min_latency: float | None = None
    max_latency: float | None = None
    time_range: str = "ALL"

    def predicate(self) -> Column | None:
        parts = []
        if self.log_types:
            parts.append(F.col("log_type").isin(list(self.log_types)))
        if self.methods:
            parts.append(F.col("method").isin(list(self.methods)))
        if self.status_classes:
            parts.append(status_class().isin(list(self.status_classes)))
        # A record without latency is never excluded by a latency bound.
        if self.max_latency is not None and self.max_latency != float("inf"):
            parts.append(F.col("latency").isNull() | (F.col("latency") <= self.max_latency))
        if self.text:
            needle = self.text.lower()
            parts.append(search_key().contains(needle) | F.lower("full_request").contains(needle))
        # The lower bound is 0 unless given, and holds as soon as anything at all is asked for.
        least = max(self.min_latency or 0.0, 0.0)
        if parts or least > 0:
            parts.append(F.col("latency").isNull() | (F.col("latency") >= least))
        return reduce(and_, parts) if parts else None


def time_slice(events: DataFrame, time_range: str) -> DataFrame:
    """Records no older than the range, counted back from the newest record.

    On a table saved by date only the folders that can hold them are read,
    both to find the newest record and for the slice.
    """
    if time_range == "ALL":
        return events
    by_date = "date" in events.columns
    latest = events.filter(F.col("date") == events.agg(F.max("date")).scalar()) if by_date else events
    newest = latest.agg(F.max("timestamp")).scalar()
    cutoff = newest - F.expr(f"INTERVAL {RANGE_MINUTES[time_range]} MINUTES")
    sliced = events.filter(F.col("timestamp") >= cutoff)
    return sliced.filter(F.col("date") >= F.to_date(cutoff)) if by_date else sliced


def query_logs(events: DataFrame, query: LogQuery = LogQuery()) -> DataFrame:
    """Time slice first, relative to the newest of all records, then the predicates."""
    sliced = time_slice(events, query.time_range)
    predicate = query.predicate()
    return sliced if predicate is None else sliced.filter(predicate)


def search(events: DataFrame, pattern: str = "", severity: str = "ALL") -> DataFrame:
    """Case-insensitive regular expression on the raw line, plus one severity.

    A pattern that is not a valid expression is looked for as plain text.
    """
    if severity != "ALL":
        events = events.filter(F.col("severity") == severity)
    if not pattern:
        return events
    # Whether it is valid is asked of the engine that will run it.
    expression = f"(?iu){pattern}"
    try:
        events.sparkSession.range(1).select(F.rlike(F.lit(""), F.lit(expression))).first()
    except PySparkException:
        return events.filter(F.lower("raw_line").contains(pattern.lower()))
    if not pattern.strip():
        return events.filter(F.lower("raw_line").contains(pattern))
    return events.filter(F.col("raw_line").rlike(expression))


def available_methods(events: DataFrame) -> DataFrame:
    return events.select("method").distinct().orderBy("method")
