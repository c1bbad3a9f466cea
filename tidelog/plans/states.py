"""Statistics of a table that grows, kept as states that merge.

A state is a small table per stretch of epochs: counts, sums and extremes per
group, counts per distinct latency, and the few rows that can ever be reported
as anomalies. Two stretches merge by the same aggregation that made them, so a
report reads states and never the events behind them.

Node i covers the epochs (i − lowest bit of i, i], counted from 1. A new epoch
merges with fewer than log2(i) earlier nodes and a report reads as many, and a
node that was written never changes. An epoch that runs again writes its node
again from the same parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.labels import endpoint_key, endpoint_label, status_class
from ..functions.times import bucket_label, coarser_label, span_ms
from ..operators import stats
from ..operators.anomalies import MIN_LATENCY, REPORTED, baselines_of, detect_anomalies
from ..operators.templates import cluster_logs
from ..schema import ARRIVAL, LOG_EVENTS
from .bundle import Stats

# -- what an epoch's events contribute -------------------------------------------------


def _requests(events: DataFrame, tz: str) -> DataFrame:
    """Counts and sums per endpoint, status class, method and hour of day."""
    label = [endpoint_label().alias("endpoint"), status_class().alias("class"), "method", stats.hour_in(tz).alias("hour")]
    stamp = F.col("timestamp")
    return _merged_requests(
        events.select(
            *label,
            F.lit(1).cast("long").alias("n"),
            F.coalesce(F.col("is_error"), F.lit(False)).cast("long").alias("errors"),
            F.col("latency").alias("latency_sum"),
            F.col("latency").isNotNull().cast("long").alias("latency_n"),
            F.col("body_bytes").cast("long").alias("bytes"),
            F.struct(*ARRIVAL).alias("first_seen"),
            stamp.alias("earliest"),
            stamp.alias("latest"),
        )
    )


def _buckets(events: DataFrame) -> DataFrame:
    """Counts per time bucket, as wide as the span of these events asks for."""
    span = events.agg(F.coalesce(span_ms(F.min("timestamp"), F.max("timestamp")), F.lit(0))).scalar()
    return events.groupBy(bucket_label("timestamp", span).alias("time")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.col("is_error"), F.lit(False))).alias("errors"),
        F.sum("latency").alias("latency_sum"),
        F.count("latency").alias("latency_n"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )


def _latencies(events: DataFrame) -> DataFrame:
    """How often each endpoint took each time."""
    known = events.filter(F.col("latency").isNotNull() & ~F.isnan("latency"))
    return known.groupBy(endpoint_key().alias("endpoint"), "latency").agg(F.count("*").alias("n"))


# -- how stretches merge ---------------------------------------------------------------


def _merged_requests(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "errors", "latency_sum", "latency_n", "bytes")]
    ends = [F.min("first_seen").alias("first_seen"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest")]
    return rows.groupBy("endpoint", "class", "method", "hour").agg(*sums, *ends)


def _merged_buckets(rows: DataFrame) -> DataFrame:
    span = rows.agg(F.coalesce(span_ms(F.min("earliest"), F.max("latest")), F.lit(0))).scalar()
    sums = [F.sum(c).alias(c) for c in ("n", "errors", "latency_sum", "latency_n")]
    ends = [F.min("earliest").alias("earliest"), F.max("latest").alias("latest")]
    return rows.groupBy(coarser_label("time", span).alias("time")).agg(*sums, *ends)


def _merged_latencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("endpoint", "latency").agg(F.sum("n").alias("n"))


def _slowest(rows: DataFrame) -> DataFrame:
    """The rows among which all reported anomalies are, whatever the baselines will be.

    Of one endpoint's rows the score picks those above some latency, so the
    slowest of each endpoint suffice; a 5xx is picked always, so the slowest of
    all suffice. Rank limits apply per partition before rows are shuffled.
    """
    order = [F.col("latency").desc_nulls_last(), *map(F.col, ARRIVAL)]
    failed = F.coalesce(F.col("status") >= 500, F.lit(False))
    place = F.row_number().over(Window.partitionBy(endpoint_key()).orderBy(*order))
    outliers = rows.filter(~failed & (F.col("latency") > MIN_LATENCY)).withColumn("place", place)
    return rows.filter(failed).orderBy(*order).limit(REPORTED).unionByName(
        outliers.filter(F.col("place") <= REPORTED).drop("place")
    )


class States:
    """The states of an event table whose epochs are its folders `epoch=N`, N from 0."""

    def __init__(self, spark: SparkSession, table: str, tz: str = "UTC"):
        self.spark, self.table, self.tz = spark, table.rstrip("/"), tz
        self.made = {
            "requests": lambda events: _requests(events, tz),
            "buckets": _buckets,
            "latencies": _latencies,
            "slowest": _slowest,
        }
        self.merge = {
            "requests": _merged_requests,
            "buckets": _merged_buckets,
            "latencies": _merged_latencies,
            "slowest": _slowest,
        }

    def events(self, first: int, last: int) -> DataFrame:
        """Events of the epochs first to last."""
        folder = str(first) if first == last else "*"
        folders = self.spark.read.option("basePath", self.table).parquet(f"{self.table}/epoch={folder}")
        return folders.filter(F.col("epoch").between(first, last)).select(*LOG_EVENTS.fieldNames())

    def _path(self, name: str, node: int) -> str:
        return f"{self.table}-states/{name}/node={node}"

    def _node(self, name: str, node: int) -> DataFrame:
        """A node as it was written; one never written, as when only the last records were reported on, from its events."""
        try:
            return self.spark.read.parquet(self._path(name, node))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.made[name](self.events(node - _low_bit(node), node - 1))

    def add(self, epoch: int) -> None:
        """Write the nodes that end with this epoch, whose events are in the table."""
        node = epoch + 1
        for name, made in self.made.items():
            parts = [made(self.events(epoch, epoch)), *(self._node(name, n) for n in _nodes(epoch, node - _low_bit(node)))]
            state = self.merge[name](reduce(DataFrame.unionByName, parts)) if parts[1:] else parts[0]
            state.write.mode("overwrite").parquet(self._path(name, node))

    def upto(self, name: str, epoch: int) -> DataFrame:
        """The state of all epochs up to this one."""
        parts = [self._node(name, n) for n in _nodes(epoch + 1)]
        return self.merge[name](reduce(DataFrame.unionByName, parts)) if parts[1:] else parts[0]


def _low_bit(node: int) -> int:
    return node & -node


def _nodes(last: int, after: int = 0) -> list[int]:
    """Nodes that together cover the epochs (after, last]; `after` must be where one of them begins."""
    found = []
    while last > after:
        found.append(last)
        last -= _low_bit(last)
    return found


# -- reports -------------------------------------------------------------------------


class MergedStats(Stats):
    """The statistics of all epochs up to one, from states; names and rows are those of `aggregate_stats`.

    There is one more, `baselines`: what `endpoint_baselines` finds. Templates
    follow a rule on messages in order, which no merge gives: `clusters` alone
    reads the events, if it is asked for.
    """

    def __init__(self, states: States, epoch: int):
        super().__init__(states.events(0, epoch), states.tz)
        requests, latencies = states.upto("requests", epoch), states.upto("latencies", epoch)
        self.builders = {
            "kpis": lambda: _kpis(requests),
            "latency_percentiles": lambda: stats.latency_percentiles(latencies, "n"),
            "golden_signals": lambda: stats.signals_of(_signal_base(requests), self["latency_percentiles"].first()),
            "requests_over_time": lambda: _over_time(states.upto("buckets", epoch)),
            "status_distribution": lambda: _distribution(requests, "class"),
            "method_distribution": lambda: _distribution(requests, "method"),
            "top_endpoints": lambda: _top_endpoints(requests),
            "latency_histogram": lambda: stats.bins_of(
                latencies, self["latency_percentiles"].first()["p95"], requests.isEmpty(), F.sum("n")
            ),
            "traffic_heatmap": lambda: stats.hours_of(_per_hour(requests)),
            "clusters": lambda: cluster_logs(self.events),
            "baselines": lambda: baselines_of(latencies, "n"),
            "anomalies": lambda: detect_anomalies(states.upto("slowest", epoch), baselines=self["baselines"]),
        }


def _mean() -> Column:
    return F.try_divide(F.sum("latency_sum"), F.sum("latency_n"))


def _percent() -> Column:
    return F.coalesce(F.try_divide(F.sum("errors") * 100.0, F.sum("n")), F.lit(0.0))


def _kpis(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
        F.coalesce(_mean(), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        _percent().alias("error_rate"),
    )


def _signal_base(requests: DataFrame) -> DataFrame:
    span = F.coalesce(span_ms(F.min("earliest"), F.max("latest")), F.lit(0))
    return requests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _percent().alias("errors"), span.alias("span"))


def _over_time(buckets: DataFrame) -> DataFrame:
    mean = F.try_divide("latency_sum", "latency_n")
    return buckets.select("time", F.col("n").alias("count"), F.col("errors").alias("error_count"), mean.alias("avg_latency")).orderBy("time")


def _distribution(requests: DataFrame, by: str) -> DataFrame:
    counted = requests.groupBy(F.col(by).alias("name")).agg(F.sum("n").alias("value"), F.min("first_seen").alias("first_seen"))
    return counted.orderBy("first_seen").select("name", "value")


def _top_endpoints(requests: DataFrame, k: int = stats.TOP_ENDPOINTS) -> DataFrame:
    per_endpoint = requests.groupBy(F.col("endpoint").alias("path")).agg(
        F.sum("n").alias("count"), _mean().alias("avg_latency"), _percent().alias("error_rate"), F.min("first_seen").alias("first_seen")
    )
    return per_endpoint.orderBy(F.desc("count"), "first_seen").limit(k).drop("first_seen")


def _per_hour(requests: DataFrame) -> DataFrame:
    return requests.groupBy("hour").agg(F.sum("n").alias("count"), (F.sum("errors") / F.sum("n")).alias("error_rate"))
