"""Aggregates of a view: KPIs, signals, distributions, series, histogram, heat map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.labels import endpoint_label, status_class
from ..functions.paths import short_path
from ..functions.scores import saturation
from ..functions.times import bucket_label, span_ms
from ..schema import ARRIVAL
from .quantiles import whole_table_ranks

# Fixed values of the reports.
PERCENTS = [50, 90, 95, 99]
TOP_ENDPOINTS = 10
CHART_ENDPOINTS = 5
HISTOGRAM_BINS = 20
HISTOGRAM_REACH = 1.5
HOT_HOUR_ERRORS = 0.05


def _first_seen() -> Column:
    return F.min(F.struct(*ARRIVAL)).alias("first_seen")


def _errors() -> Column:
    return F.count_if(F.coalesce(F.col("is_error"), F.lit(False)))


def _error_percent() -> Column:
    return F.coalesce(F.try_divide(_errors() * 100.0, F.count("*")), F.lit(0.0))


def kpis(events: DataFrame) -> DataFrame:
    """One row; zeros for an empty view. Error rate in percent."""
    return events.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.sum("body_bytes"), F.lit(0)).alias("total_bytes"),
        _error_percent().alias("error_rate"),
    )


def latency_percentiles(events: DataFrame, weight: str | None = None) -> DataFrame:
    """One row p50, p90, p95, p99 by nearest rank; a row counts `weight` times if a column is named."""
    _, found = whole_table_ranks(events, "latency", PERCENTS, weight)
    columns = ", ".join(f"p{p} double" for p in PERCENTS)
    return events.sparkSession.createDataFrame([tuple(found.get(p, 0.0) for p in PERCENTS)], columns)


def approx_latency_percentiles(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Sketch-based alternative in one pass; rank error below n / accuracy."""
    values = F.percentile_approx("latency", [p / 100 for p in PERCENTS], accuracy)
    return events.agg(values.alias("q")).select(
        *[F.coalesce(F.col("q")[i], F.lit(0.0)).alias(f"p{p}") for i, p in enumerate(PERCENTS)]
    )


def _distribution(events: DataFrame, name: Column) -> DataFrame:
    counted = events.groupBy(name.alias("name")).agg(F.count("*").alias("value"), _first_seen())
    return counted.orderBy("first_seen").select("name", "value")


def status_distribution(events: DataFrame) -> DataFrame:
    return _distribution(events, status_class())


def method_distribution(events: DataFrame) -> DataFrame:
    return _distribution(events, F.col("method"))


def top_endpoints(events: DataFrame, k: int = TOP_ENDPOINTS) -> DataFrame:
    """Busiest endpoints; equal counts keep the order of first appearance."""
    per_endpoint = events.groupBy(endpoint_label().alias("path")).agg(
        F.count("*").alias("count"),
        F.avg("latency").alias("avg_latency"),
        _error_percent().alias("error_rate"),
        _first_seen(),
    )
    return per_endpoint.orderBy(F.desc("count"), "first_seen").limit(k).drop("first_seen")


def top_endpoints_chart(events: DataFrame) -> DataFrame:
    return top_endpoints(events, CHART_ENDPOINTS).withColumn("short_path", short_path("path"))


def _span(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(span_ms(F.min("timestamp"), F.max("timestamp")), F.lit(0)).alias("span"))


def requests_over_time(events: DataFrame) -> DataFrame:
    """Counts per time bucket; the width follows from the span of the whole view."""
    bucket = bucket_label("timestamp", _span(events).scalar())
    return (
        events.groupBy(bucket.alias("time"))
        .agg(F.count("*").alias("count"), _errors().alias("error_count"), F.avg("latency").alias("avg_latency"))
        .orderBy("time")
    )


def golden_signals(events: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """latency (p95), traffic per second, errors in percent, saturation 0–100.

    `percentiles` are those of `latency_percentiles`, if they are there already.
    """
    quantiles = (percentiles or latency_percentiles(events)).first()
    base = events.agg(
        F.count("*").alias("n"),
        _error_percent().alias("errors"),
        F.coalesce(span_ms(F.min("timestamp"), F.max("timestamp")), F.lit(0)).alias("span"),
    )
    return signals_of(base, quantiles)


def signals_of(base: DataFrame, quantiles: Row) -> DataFrame:
    """Golden signals from one row (n, errors in percent, span in ms) and the percentiles."""
    base = base.select(
        "errors",
        F.when(F.col("span") > 0, F.col("n") / (F.col("span") / 1000)).otherwise(F.col("n").cast("double")).alias("traffic"),
        F.lit(quantiles["p50"]).alias("p50"),
        F.lit(quantiles["p95"]).alias("latency"),
    )
    load = saturation(F.col("traffic"), F.col("p50"), F.col("latency"), F.col("errors"))
    return base.select("latency", "traffic", "errors", load.alias("saturation"))


def latency_histogram(events: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """Twenty bins up to 1.5 · p95, empty ones included; values outside are left out. No bins for an empty view.

    The p95 is one number and is fetched first: as a literal it keeps the plan
    of the counting pass small and its bound is pushed into the scan.
    """
    p95 = percentiles.first()["p95"] if percentiles else whole_table_ranks(events, "latency", [95])[1].get(95, 0.0)
    return bins_of(events, p95, events.isEmpty(), F.count("*"))


def bins_of(rows: DataFrame, p95: float, empty: bool, counted_by: Column) -> DataFrame:
    """The bins of rows with a `latency`, counted by an aggregate; none for an empty view."""
    reach = p95 * HISTOGRAM_REACH
    width = reach / HISTOGRAM_BINS or 1.0
    binned = rows.filter(F.col("latency") <= reach).withColumn("bin", F.floor(F.col("latency") / width))
    counted = binned.filter(F.col("bin").between(0, HISTOGRAM_BINS - 1)).groupBy("bin").agg(counted_by.alias("count"))
    some = 0 if empty else HISTOGRAM_BINS
    bins = rows.sparkSession.range(some).withColumnRenamed("id", "bin")

    def edge(i: Column) -> Column:
        return F.round(i * width, 0).cast("bigint").cast("string")

    return (
        bins.join(F.broadcast(counted), "bin", "left")
        .select(
            F.concat(edge(F.col("bin")), F.lit("-"), edge(F.col("bin") + 1), F.lit("ms")).alias("range"),
            F.coalesce("count", F.lit(0)).alias("count"),
            (F.col("bin") * width).alias("min"),
        )
        .orderBy("min")
    )


def hour_in(tz: str) -> Column:
    """Hour of day in `tz`."""
    return F.hour(F.convert_timezone(F.current_timezone(), F.lit(tz), F.col("timestamp").cast("timestamp_ntz")))


def traffic_heatmap(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Count and error fraction per hour of day in `tz`, all 24 hours; none for an empty view."""
    per_hour = events.groupBy(hour_in(tz).alias("hour")).agg(
        F.count("*").alias("count"), (_errors() / F.count("*")).alias("error_rate")
    )
    return hours_of(per_hour)


def hours_of(per_hour: DataFrame) -> DataFrame:
    """All 24 hours from the counts of those that occur."""
    hours = per_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    # At most 24 groups.
    return (
        hours.join(F.broadcast(per_hour), "hour", "left")
        .withColumn("all", F.sum("count").over(Window.partitionBy()))
        .filter("all > 0")
        .select("hour", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"))
        .orderBy("hour")
    )


def heatmap_intensity(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Drawing attributes of the heat map, relative to the busiest hour."""
    hours = traffic_heatmap(events, tz)
    busiest = F.greatest(hours.agg(F.max("count")).scalar(), F.lit(1))
    share = F.col("count") / busiest
    return hours.select(
        "hour",
        "count",
        share.alias("intensity"),
        (F.col("error_rate") > HOT_HOUR_ERRORS).alias("has_errors"),
        F.greatest(F.lit(0.2), share).alias("opacity"),
        F.greatest(F.lit(5.0), share * 100).alias("height"),
    ).orderBy("hour")
