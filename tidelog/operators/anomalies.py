"""Slow requests against the baseline of their own endpoint, and all 5xx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import endpoint_key
from ..functions.scores import robust_z
from ..plans.lookup import lookup_join
from ..session import materialize
from .quantiles import medians

# Fixed values of the rule.
MIN_SAMPLES = 3
MIN_SCORE = 3
MIN_LATENCY = 50
REPORTED = 50


def endpoint_baselines(events: DataFrame) -> DataFrame:
    """(endpoint, n, median, mad) of the latencies of every endpoint.

    Endpoint and latency are written once and read by every pass of both
    medians; the middle of an endpoint meets its rows by a join on the endpoint.
    """
    return baselines_of(materialize(events.select(endpoint_key().alias("endpoint"), F.col("latency").cast("double").alias("latency")), "latencies"))


def baselines_of(keyed: DataFrame, weight: str | None = None) -> DataFrame:
    """The same from (endpoint, latency); a row counts as often as the column `weight` says."""
    centre = materialize(medians(keyed, F.col("latency"), ["endpoint"], weight), "medians")
    away = F.abs(F.col("latency") - F.col("median"))
    spread = medians(keyed.join(centre.drop("n"), "endpoint"), away, ["endpoint"], weight).select("endpoint", F.col("median").alias("mad"))
    return materialize(centre.join(spread, "endpoint"), "baselines")


def score(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add `anomaly_score`; endpoints with fewer than three samples score 0.

    `baselines` must be a table that has been written (see endpoint_baselines).
    """
    keyed = events.withColumn("endpoint", endpoint_key())
    joined = lookup_join(keyed, baselines, ["endpoint"], weight="n", how="left")
    return joined.withColumn("anomaly_score", score_column()).drop("endpoint", "n", "median", "mad")


def score_column() -> Column:
    z = robust_z(F.col("latency"), F.col("median"), F.col("mad"))
    return F.when(F.col("n") >= MIN_SAMPLES, F.coalesce(z, F.lit(0.0))).otherwise(0.0)


def could_be_flagged() -> Column:
    """What a record must be whatever its score; lets most rows go before the join."""
    return (F.col("status") >= 500) | (F.col("latency") > MIN_LATENCY)


def is_anomaly() -> Column:
    outlier = (F.col("anomaly_score") > MIN_SCORE) & (F.col("latency") > MIN_LATENCY)
    return (F.col("status") >= 500) | outlier


def detect_anomalies(events: DataFrame, k: int = REPORTED, baselines: DataFrame | None = None) -> DataFrame:
    """The k slowest anomalous records; ties go to the earlier one."""
    table = endpoint_baselines(events) if baselines is None else baselines
    flagged = score(events.filter(could_be_flagged()), table).filter(is_anomaly())
    return flagged.orderBy(F.col("latency").desc_nulls_last(), "idx", "source").limit(k)
