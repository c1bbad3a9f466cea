"""The one record type every parser produces and every operator reads."""

from __future__ import annotations

from pyspark.sql import types as T

LINES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("line", T.StringType()),
])

LOG_EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("original_timestamp", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("full_request", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("upstream_latency", T.DoubleType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("remote_ip", T.StringType()),
    T.StructField("referer", T.StringType()),
    T.StructField("is_error", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("log_type", T.StringType()),
    T.StructField("body_bytes", T.LongType()),
    T.StructField("raw_line", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

EVENT_COLUMNS = LOG_EVENTS.fieldNames()

# Arrival order. `idx` counts within a source; `source` only breaks ties when
# several files were read side by side.
ARRIVAL = ("idx", "source")
