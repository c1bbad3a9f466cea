"""Saved `log_events` tables and the CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..schema import LOG_EVENTS

# Export columns.
EXPORT_COLUMNS = {
    "Timestamp": "timestamp",
    "Severity": "severity",
    "Method": "method",
    "Path": "path",
    "Status": "status",
    "Latency(ms)": "latency",
    "Message": "full_request",
    "UserAgent": "user_agent",
    "RemoteIP": "remote_ip",
}


def save_events(events: DataFrame, path: str, by_date: bool = False) -> None:
    """Write a snapshot; `by_date` partitions it so that time filters prune files."""
    if by_date:
        # Dealt by date, large dates over several tasks, so that a date gets few files.
        dated = events.withColumn("date", F.to_date("timestamp")).hint("rebalance", "date")
        dated.write.mode("overwrite").partitionBy("date").parquet(path)
    else:
        events.write.mode("overwrite").parquet(path)


def load_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved snapshot, or None if there is none or it is empty."""
    try:
        saved = spark.read.schema(LOG_EVENTS).parquet(path)
        return None if saved.isEmpty() else saved
    except AnalysisException:
        return None


def clear_events(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LOG_EVENTS).write.mode("overwrite").parquet(path)


def export_view(events: DataFrame) -> DataFrame:
    """Columns of the export, timestamps as ISO text in UTC."""
    zone = F.current_timezone()
    utc = F.convert_timezone(zone, F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz"))
    iso = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(
        *[(iso if c == "timestamp" else F.col(c)).alias(name) for name, c in EXPORT_COLUMNS.items()]
    )


def export_csv(events: DataFrame, path: str) -> bool:
    """Write the view as CSV files; an empty view writes nothing and gives False."""
    if events.isEmpty():
        return False
    export_view(events).write.option("header", True).option("escape", '"').csv(path)
    return True
