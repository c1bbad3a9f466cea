"""The whole set of statistics of one view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import stats
from ..operators.anomalies import detect_anomalies
from ..operators.query import LogQuery
from ..operators.templates import cluster_logs
from ..session import materialize


# What the statistics read; raw lines and metadata stay where they are.
USED = ("id", "source", "idx", "timestamp", "method", "path", "full_request", "status", "latency", "is_error", "severity", "log_type", "body_bytes")


class Stats(dict):
    """Name → DataFrame; a statistic is only planned when it is asked for."""

    def __init__(self, events: DataFrame, tz: str = "UTC"):
        super().__init__()
        self.events = events
        self.builders = {
            "kpis": lambda: stats.kpis(events),
            "latency_percentiles": lambda: stats.latency_percentiles(events),
            "golden_signals": lambda: stats.golden_signals(events, self["latency_percentiles"]),
            "requests_over_time": lambda: stats.requests_over_time(events),
            "status_distribution": lambda: stats.status_distribution(events),
            "method_distribution": lambda: stats.method_distribution(events),
            "top_endpoints": lambda: stats.top_endpoints(events),
            "latency_histogram": lambda: stats.latency_histogram(events, self["latency_percentiles"]),
            "traffic_heatmap": lambda: stats.traffic_heatmap(events, tz),
            "clusters": lambda: cluster_logs(events),
            "anomalies": lambda: detect_anomalies(events),
        }

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.builders[name]()
        return self[name]

    def names(self) -> list[str]:
        return list(self.builders)


def aggregate_stats(events: DataFrame, tz: str = "UTC", saved: bool = False) -> Stats:
    """All statistics of a view. The view is written once and read by each of
    them; pass `saved` for a view that is already a plain read of a table."""
    return Stats(events if saved else materialize(events.select(*USED), "view"), tz)


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def view_digest(events: DataFrame, query: LogQuery = LogQuery(), stats_of: Stats | None = None) -> DataFrame:
    """One row of text that sums up the view: totals, worst endpoints, patterns, filters."""
    s = stats_of if stats_of is not None else aggregate_stats(events)
    k = s["kpis"]

    def one(name: str) -> Column:
        return k.select(name).scalar()

    endpoint = F.concat("path", F.lit(" ("), _fixed(F.col("error_rate"), 1), F.lit("% errors)"))
    place = F.monotonically_increasing_id()
    # Both lists are at most ten and twenty rows.
    endpoints = _joined(s["top_endpoints"].limit(5).select(place.alias("at"), endpoint.alias("text")), ", ")
    patterns = _joined(s["clusters"].limit(3).select(place.alias("at"), F.col("template").alias("text")), "\n")
    active = bool(query.methods or query.status_classes or query.text)
    low = "0" if query.min_latency is None else f"{query.min_latency:g}"
    high = "∞" if query.max_latency is None else f"{query.max_latency:g}"
    filters = (
        f'Time: {query.time_range}, Query: "{query.text or "None"}", '
        f"Methods: {', '.join(query.methods) or 'All'}, Status: {', '.join(query.status_classes) or 'All'}, "
        f"Latency: {low}ms - {high}ms"
        if active
        else ""
    )
    return events.sparkSession.range(1).select(
        one("total_requests").alias("total_requests"),
        _fixed(one("error_rate"), 2).alias("error_rate"),
        _fixed(one("avg_latency"), 2).alias("avg_latency"),
        _fixed(s["latency_percentiles"].select("p95").scalar(), 2).alias("p95_latency"),
        s["anomalies"].agg(F.count("*")).scalar().alias("anomalies"),
        F.coalesce(endpoints, F.lit("")).alias("top_endpoints"),
        F.coalesce(patterns, F.lit("")).alias("patterns"),
        F.lit(filters).alias("filters"),
    )


def _joined(rows: DataFrame, separator: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("at", "text")))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator)).scalar()
