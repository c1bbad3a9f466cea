"""Log records and log lines derived from the driver's `events` table.

The tables hold no log lines, so every parse query renders each event as a
line of some format first and parses that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.ids import log_id
from .schema import LOG_EVENTS

TEXT_KINDS = ("clf", "alb", "envoy", "java", "mongo", "redis", "syslog", "k8s", "postgres")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, with the attributes every rendering draws on."""
    events = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    method = (
        F.when(kind.isin("click", "signup"), "POST").when(kind == "purchase", "PUT").otherwise("GET")
    )
    status = (
        F.when(kind == "error", F.when(k % 2 == 0, 500).otherwise(404))
        .when(kind == "signup", 201)
        .when((kind == "purchase") & (k % 10 == 0), 302)
        .otherwise(200)
    )
    segment = F.when(kind == "error", "view").otherwise(kind)
    slot = F.col("event_id") % 20
    return events.select(
        "event_id",
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"),
        "user_id",
        method.alias("method"),
        segment.alias("segment"),
        F.concat(F.lit("/api/"), segment, F.lit("/"), F.col("user_id")).alias("raw_path"),
        status.alias("status"),
        F.col("value").alias("latency"),
        (k * 100).cast("bigint").alias("body_bytes"),
        F.concat(F.lit("ua/"), F.col("user_id") % 5).alias("user_agent"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("remote_ip"),
        F.when(slot == 7, "DATABASE").when(slot == 8, "SYSTEM").when(slot == 9, "APP").otherwise("HTTP").alias("log_type"),
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `log_events` table the filters, statistics, anomalies and templates read."""
    status = F.col("status")
    request = F.concat_ws(" ", "method", "raw_path")
    columns = {
        "id": log_id(request, F.col("event_id")),
        "source": F.lit("events"),
        "idx": F.col("event_id"),
        "timestamp": F.col("ts"),
        "original_timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        "path": F.concat(F.lit("/api/"), "segment", F.lit("/:id")),
        "full_request": request,
        "upstream_latency": F.lit(0.0),
        "referer": F.lit("-"),
        "is_error": status >= 400,
        "severity": F.when(status >= 500, "CRITICAL").when(status >= 400, "ERROR").otherwise("INFO"),
        "raw_line": request,
        "metadata": F.create_map().cast("map<string,string>"),
    }
    return requests(spark, sf_dir).select(
        *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in LOG_EVENTS.fields]
    )


def _iso(pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS") -> Column:
    return F.date_format("ts", pattern)


def _ms() -> Column:
    return F.col("latency").cast("decimal(18,2)").cast("string")


def _whole_ms() -> Column:
    return F.round("latency", 0).cast("bigint").cast("string")


def _level() -> Column:
    return F.when(F.col("status") >= 400, "ERROR").otherwise("INFO")


def render(kind: str) -> Column:
    """Text of one request in the given format."""
    c, lit = F.col, F.lit
    request = F.concat_ws(" ", "method", "raw_path")
    seconds = (c("latency") / 1000).cast("decimal(18,5)").cast("string")
    if kind == "clf":
        return F.format_string(
            '%s - - [%s +0000] "%s HTTP/1.1" %d %d "-" "%s" %s',
            c("remote_ip"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), request, c("status"), c("body_bytes"),
            c("user_agent"), seconds,
        )
    if kind == "alb":
        return F.format_string(
            '%sZ app/lb/1 %s:80 10.1.0.1:80 0.000 %s 0.000 %d %d 10 20 "%s HTTP/1.1" "%s" ECDHE TLSv1.2',
            _iso(), c("remote_ip"), seconds, c("status"), c("status"), request, c("user_agent"),
        )
    if kind == "envoy":
        return F.format_string(
            '[%sZ] "%s HTTP/1.1" %d - %d 20 %s 3 "-" "%s" "%d" "api"',
            _iso(), request, c("status"), c("body_bytes"), _whole_ms(), c("user_agent"), c("event_id"),
        )
    if kind == "java":
        return F.format_string(
            "%s %s %d --- [exec-1] c.e.web.Controller : Handled %s status %d",
            _iso("yyyy-MM-dd HH:mm:ss.SSS"), _level(), c("user_id"), request, c("status"),
        )
    if kind == "mongo":
        return F.format_string(
            "%s+0000 %s COMMAND  [conn%d] command db.%s command: %s { q: 1 } protocol:op_msg %sms",
            _iso(), F.substring(_level(), 1, 1), c("user_id"), c("segment"), F.lower("method"), _whole_ms(),
        )
    if kind == "redis":
        return F.format_string(
            "%d:M %s %s %s took %s",
            c("user_id"), F.date_format("ts", "dd MMM yyyy HH:mm:ss.SSS"),
            F.when(c("status") >= 400, "#").otherwise("*"), request, _ms(),
        )
    if kind == "syslog":
        return F.format_string(
            "<34>%sZ %s web[%d]: %s %d", _iso(), c("remote_ip"), c("user_id"), request, c("status")
        )
    if kind == "k8s":
        return F.format_string(
            "%sZ %s F I0101 1 %s.go:1] %s %d %sms",
            _iso(), F.when(c("status") >= 500, "stderr").otherwise("stdout"), c("segment"), request, c("status"), _whole_ms(),
        )
    if kind == "postgres":
        return F.format_string(
            "%s UTC [%d] u@db %s: duration: %s ms statement: SELECT * FROM %s",
            _iso("yyyy-MM-dd HH:mm:ss.SSS"), c("user_id"), F.when(c("status") >= 400, "ERROR").otherwise("LOG"),
            _ms(), c("segment"),
        )
    if kind == "json":
        http = F.struct(
            c("method").alias("requestMethod"), c("raw_path").alias("requestUrl"), c("status"),
            F.concat(seconds, lit("s")).alias("latency"), c("remote_ip").alias("remoteIp"),
            c("user_agent").alias("userAgent"), c("body_bytes").cast("string").alias("responseSize"),
        )
        return F.to_json(F.struct(http.alias("httpRequest"), F.concat(_iso(), lit("Z")).alias("timestamp")))
    if kind == "app_json":
        return F.to_json(
            F.struct(
                F.unix_millis("ts").alias("ts"), _level().alias("level"), "method", c("raw_path").alias("path"),
                "status", c("latency").alias("duration"),
            )
        )
    if kind == "csv":
        return F.format_string(
            '%sZ,%s,"%s",%d,%s,"said ""hi"", ok"', _iso(), c("method"), c("raw_path"), c("status"), _ms()
        )
    if kind == "w3c":
        return F.concat_ws(
            "\t", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), "method", "raw_path",
            c("status").cast("string"), seconds,
        )
    raise ValueError(kind)


HEADERS = {
    "csv": ["timestamp,method,path,status,latency,note"],
    "w3c": ["#Version: 1.0", "#Fields: date time cs-method cs-uri-stem sc-status time-taken"],
}


def lines_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One source holding every event in one format; `idx` leaves room for the header."""
    head = HEADERS.get(kind, [])
    body = requests(spark, sf_dir).select(
        F.lit(f"{kind}.log").alias("source"), (F.col("event_id") + len(head)).alias("idx"), render(kind).alias("line")
    )
    if not head:
        return body
    rows = [(f"{kind}.log", i, text) for i, text in enumerate(head)]
    return spark.createDataFrame(rows, body.schema).unionByName(body)


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source in which the nine text formats take turns."""
    turn = F.col("event_id") % len(TEXT_KINDS)
    line = F.when(turn == 0, render(TEXT_KINDS[0]))
    for place, kind in enumerate(TEXT_KINDS[1:], 1):
        line = line.when(turn == place, render(kind))
    return requests(spark, sf_dir).select(
        F.lit("mixed.log").alias("source"), F.col("event_id").alias("idx"), line.alias("line")
    )
