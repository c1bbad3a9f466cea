"""Small log_events tables for tests."""

from pyspark.sql import functions as F

from tidelog.schema import LOG_EVENTS

DEFAULTS = {
    "id": "x", "source": "t", "idx": 0, "timestamp": None, "original_timestamp": "", "method": "GET", "path": "/api",
    "full_request": "GET /api", "status": 200, "latency": 10.0, "upstream_latency": 0.0, "user_agent": "-",
    "remote_ip": "-", "referer": "-", "is_error": None, "severity": "INFO", "log_type": "HTTP", "body_bytes": 0,
    "raw_line": "", "metadata": {},
}


def events(spark, rows, time="2025-01-17 14:32:00"):
    out = []
    for i, row in enumerate(rows):
        r = {**DEFAULTS, "idx": i, "timestamp": time, **row}
        if r["is_error"] is None:
            r["is_error"] = (r["status"] or 0) >= 400
        out.append(tuple(r[f.name] for f in LOG_EVENTS.fields))
    schema = ", ".join(
        f"{f.name} {'string' if f.name == 'timestamp' else f.dataType.simpleString()}" for f in LOG_EVENTS.fields
    )
    return spark.createDataFrame(out, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def lines(spark, text, source="s"):
    rows = [(source, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source string, idx long, line string")
