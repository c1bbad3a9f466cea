"""One query per operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tidelog as tl
from tidelog import fixtures as fx
from tidelog import functions as fn
from tidelog.operators import stats
from tidelog.operators.templates import all_templates, grouped_messages
from tidelog.parsers import GENERIC, get_field as read_field, known_formats, parse_csv, parse_json
from tidelog.parsers.base import ParseContext, ParserSpec
from tidelog.operators.quantiles import medians
from tidelog.session import materialize, scratch_path

NOW = "2030-01-01 00:00:00"


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Wide projections beyond this size are run in pieces the JVM can compile.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def context(**kw) -> ParseContext:
    return ParseContext(now=F.lit(NOW).cast("timestamp"), **kw)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stamp(c: str = "timestamp") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def on_events(build):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(fx.log_events(ready(spark), sf))

    return run


def on_saved_events(build):
    """For operators that pass over the view many times."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(materialize(fx.log_events(ready(spark), sf), "view"))

    return run


def on_table(name: str, build):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(fx.read_table(ready(spark), sf, name))

    return run


# -- functions -----------------------------------------------------------------

def normalize_path(pages):
    request = F.concat(F.lit("GET "), F.col("url"))
    return pages.select("page_id", fn.normalize_path(request).alias("r")).select("page_id", "r.method", "r.path")


def parse_date(spark, sf):
    r = fx.requests(ready(spark), sf)
    texts = [
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.date_format("ts", "d MMM yyyy HH:mm:ss.SSS"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        F.date_format("ts", "yyyy/M/d H:mm:ss"),
        F.date_format("ts", "MMM d HH:mm:ss"),
        F.lit("not a date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"),
    ]
    turn = F.col("event_id") % len(texts)
    text = F.when(turn == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        text = text.when(turn == i, t)
    parsed = fn.parse_date(text, F.lit(NOW).cast("timestamp"), syslog_year=2024)
    return r.select("event_id", parsed.alias("t")).select("event_id", stamp("t").alias("t"))


def epoch_time(spark, sf):
    r = fx.requests(ready(spark), sf)
    millis = F.unix_millis("ts")
    number = F.when(F.col("event_id") % 2 == 0, millis).otherwise(F.floor(millis / 1000))
    return r.select("event_id", fn.epoch_time(number).alias("t")).select("event_id", stamp("t").alias("t"))


def lenient_numbers(spark, sf):
    r = fx.requests(ready(spark), sf)
    text = F.concat(F.lit(" "), F.col("latency").cast("decimal(18,2)").cast("string"), F.lit("ms"))
    unit = F.concat(F.col("latency").cast("decimal(18,2)").cast("string"), F.when(F.col("event_id") % 2 == 0, "s").otherwise(""))
    return r.select(
        "event_id",
        r6(fn.lenient_float(text)).alias("number"),
        fn.lenient_int(text, "bigint").alias("whole"),
        r6(fn.duration_ms(unit)).alias("duration"),
        fn.lenient_float(F.col("method")).isNull().alias("not_a_number"),
    )


def record_labels(ev):
    return ev.select(
        "idx",
        fn.status_class().alias("status_class"),
        fn.endpoint_label().alias("endpoint_label"),
        fn.endpoint_key().alias("endpoint_key"),
        fn.search_key().alias("search_key"),
        fn.display_status().alias("display_status"),
        fn.determine_severity("status", "full_request").alias("severity"),
    )


def bucket_labels(ev):
    spans = {"seconds": 60_000, "minutes": 3_600_000, "ten_minutes": 86_400_000, "hours": 10 * 86_400_000}
    return ev.select("idx", *[fn.bucket_label("timestamp", F.lit(s)).alias(n) for n, s in spans.items()])


def token_algebra(ev):
    tokens = fn.tokenize("full_request")
    other = F.array(F.col("method"), F.concat(F.lit("/api/view/"), F.col("idx") % 150))
    return ev.select(
        "idx",
        r6(fn.token_similarity(tokens, other)).alias("similarity"),
        F.array_join(fn.merge_tokens(tokens, other), " ").alias("merged"),
        fn.prefix_token("remote_ip").alias("ip_prefix"),
        fn.group_key("tokens" if "tokens" in ev.columns else tokens).alias("group_key"),
    )


def saturation(spark, sf):
    r = fx.requests(ready(spark), sf)
    score = fn.saturation(F.ln(F.col("user_id") + 2), F.col("latency"), F.col("latency") * 2.5 + F.ln(F.col("user_id") + 2), F.col("body_bytes") / 1000)
    return r.select("event_id", r6(score).alias("saturation"))


def scalar_payload(spark, sf):
    e = fx.read_table(ready(spark), sf, "events")
    nested = F.concat(F.lit('{"a":null,"o":{"x":1},"l":[1],"t":"v","p":'), F.regexp_extract("props", r"(\d+)", 1), F.lit("}"))
    m = fn.scalar_payload(F.parse_json(nested))
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), m["p"].alias("p"), m["t"].alias("t"))


# -- filters ---------------------------------------------------------------------

def ids_of(query):
    return lambda ev: tl.query_logs(ev, query).select("idx")


# -- parse jobs --------------------------------------------------------------------

def event_view(ev: DataFrame, *more: Column | str) -> DataFrame:
    return ev.select(
        "idx", "id", stamp().alias("time"), "method", "path", "full_request", "status", r6("latency").alias("latency"),
        r6("upstream_latency").alias("upstream_latency"), "user_agent", "remote_ip", "referer", "is_error", "severity",
        "log_type", "body_bytes", *more,
    )


def parse_kind(kind: str):
    def run(spark, sf):
        lines = fx.lines_of(ready(spark), sf, kind)
        if kind in ("json", "app_json"):
            return event_view(parse_json(lines, context())).drop("id")
        if kind in ("csv", "w3c"):
            return event_view(parse_csv(lines, context())).drop("id")
        spec = GENERIC if kind == "generic" else next(s for s in known_formats() if s.id == kind)
        return event_view(tl.parse_with(spec, lines, context())).drop("id")

    return run


def parse_generic(spark, sf):
    docs = fx.read_table(ready(spark), sf, "documents")
    lines = docs.select(F.lit("d").alias("source"), F.col("doc_id").alias("idx"), F.regexp_replace("text", r"\n", " ").alias("line"))
    return tl.parse_with(GENERIC, lines, context()).select("idx", "method", "path", "full_request", "log_type", stamp().alias("time"))


def parse_mixed(spark, sf):
    lines = fx.mixed_lines(ready(spark), sf)
    return event_view(tl.parse_logs(lines, context())).select(
        "idx", "time", "method", "path", "status", "latency", "is_error", "severity", "log_type"
    )


def get_field(spark, sf):
    e = fx.read_table(ready(spark), sf, "events")
    digits = F.regexp_extract("props", r"(\d+)", 1)
    odd = F.concat(F.lit('{"a.b":'), digits, F.lit(',"a":{"b":0},"n":null}'))
    even = F.concat(F.lit('{"a":{"b":'), digits, F.lit('},"c":1}'))
    v = F.parse_json(F.when(F.col("event_id") % 2 == 1, odd).otherwise(even))
    return e.select(
        "event_id",
        read_field(v, ("x", "a.b", "c")).cast("long").alias("nested"),
        read_field(v, ("n", "c")).cast("long").alias("hidden"),
    )


def json_documents(spark, sf):
    """Lines that are one document, two, one with more behind it, one with a key that comes twice, and none."""
    r = fx.requests(ready(spark), sf)
    one = F.format_string('{"message":"GET %s","status":%d}', F.col("raw_path"), F.col("status"))
    kinds = [
        one, F.concat(one, F.lit(" "), one), F.concat(one, F.lit("}")), F.concat(one, F.lit("],["), one),
        F.concat(F.lit('{"a":1,"a":2,'), F.substr(one, F.lit(2))), F.concat(one, F.lit(" x")), F.lit("{'a':1}"), F.lit("null"),
    ]
    turn = F.col("event_id") % len(kinds)
    line = F.when(turn == 0, kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        line = line.when(turn == i, k)
    lines = r.select(F.lit("j").alias("source"), F.col("event_id").alias("idx"), line.alias("line"))
    return parse_json(lines, context()).select("idx", "method", "path", "status")


def registered_format(spark, sf):
    """A format of the user's own, settled on for a source of its lines."""
    spec = ParserSpec(
        id="hashes",
        matches=lambda line: line.startswith("##"),
        fields=lambda line, groups: {
            "method": F.lit("HASH"),
            "path": F.split_part(line, F.lit("|"), F.lit(2)),
            "status": F.split_part(line, F.lit("|"), F.lit(3)).cast("int"),
        },
    )
    r = fx.requests(ready(spark), sf)
    lines = r.select(
        F.lit("h").alias("source"), F.col("event_id").alias("idx"), F.concat_ws("|", F.lit("##"), "raw_path", "status").alias("line")
    )
    forget = tl.register_parser(spec)
    try:
        return tl.parse_logs(lines, context()).select("idx", "method", "path", "status", "is_error")
    finally:
        forget()


def parse_many_sources(spark, sf):
    ready(spark)
    kinds = ["clf", "json", "csv", "w3c", "k8s"]
    lines = fx.lines_of(spark, sf, kinds[0])
    for kind in kinds[1:]:
        lines = lines.unionByName(fx.lines_of(spark, sf, kind))
    parsed = tl.parse_logs(lines, context())
    return parsed.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.sum("status").alias("status_sum"),
        F.sum(F.length("method")).alias("method_chars"),
    )


def detect_format(spark, sf):
    ready(spark)
    kinds = [*fx.TEXT_KINDS, "json", "csv", "w3c"]
    lines = fx.lines_of(spark, sf, kinds[0])
    for kind in kinds[1:]:
        lines = lines.unionByName(fx.lines_of(spark, sf, kind))
    return rounded(tl.detect_format(lines.unionByName(fx.mixed_lines(spark, sf))), "score")


def log_ids(pages):
    return pages.select("page_id", fn.log_id("url", "page_id").alias("id"))


# -- sources ------------------------------------------------------------------------

def _written_lines(spark, sf, **options):
    path = scratch_path(spark, "lines")
    text = fx.lines_of(ready(spark), sf, "clf")
    text.repartitionByRange(4, "idx").sortWithinPartitions("idx").select("line").write.options(**options).text(path)
    return path


def _line_report(lines: DataFrame) -> DataFrame:
    per_file = lines.groupBy("source").agg(
        F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_distinct("idx").alias("d")
    )
    return per_file.agg(
        F.sum("n").alias("lines"),
        F.sum((F.col("lo") == 0).cast("int")).alias("files_from_zero"),
        F.sum(((F.col("hi") + 1 == F.col("n")) & (F.col("d") == F.col("n"))).cast("int")).alias("files_without_gap"),
    )


def read_lines(spark, sf):
    """Lines of two files, every tenth one blank, in blocks of 64 KiB when indexed and of another size when read."""
    path = scratch_path(spark, "lines")
    texts = fx.requests(ready(spark), sf).select(
        (F.col("event_id") % 2).alias("part"), "event_id",
        F.when(F.col("event_id") % 10 < 2, " ").otherwise(F.concat_ws(" ", "method", "raw_path", "event_id")).alias("line"),
    )
    texts.repartition(2, "part").sortWithinPartitions("part", "event_id").select("part", "line").write.partitionBy("part").text(path)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
    try:
        lines = tl.read_lines(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    return lines.select(F.regexp_extract("source", r"part=(\d)", 1).cast("long").alias("part"), "idx", "line")


def read_gzip_lines(spark, sf):
    return _line_report(tl.read_lines(spark, _written_lines(spark, sf, compression="gzip")))


def saved_events(spark, sf):
    path = scratch_path(spark, "session")
    tl.save_events(fx.log_events(ready(spark), sf), path, by_date=True)
    return event_view(tl.load_events(spark, path))


def saved_slice(spark, sf):
    """Time slice on a table saved by date: reads the newest folders only."""
    path = scratch_path(spark, "by-date")
    tl.save_events(fx.log_events(ready(spark), sf), path, by_date=True)
    return tl.query_logs(tl.load_events(spark, path), tl.LogQuery(time_range="24H")).select("idx")


def exported_csv(spark, sf):
    path = scratch_path(spark, "export")
    tl.export_csv(fx.log_events(ready(spark), sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        "Timestamp", "Severity", "Method", "Path", F.col("Status").cast("int").alias("Status"),
        r6(F.col("`Latency(ms)`").cast("double")).alias("latency"), "Message", "UserAgent", "RemoteIP",
    )


def append_ids(ev):
    both = tl.append(ev.filter("log_type = 'HTTP'"), ev.filter("log_type <> 'HTTP'"))
    return both.filter("log_type <> 'HTTP'").select("idx", "id")


def cleared(spark, sf):
    path = scratch_path(spark, "cleared")
    tl.save_events(fx.log_events(ready(spark), sf), path)
    tl.clear_events(spark, path)
    left = spark.read.parquet(path).agg(F.count("*").alias("n"))
    return left.withColumn("loaded", F.lit(tl.load_events(spark, path) is not None))


def append(ev):
    both = tl.append(ev.filter("log_type = 'HTTP'"), ev.filter("log_type <> 'HTTP'"))
    return both.groupBy("log_type").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))


# -- anomalies and templates ------------------------------------------------------------

def baselines(ev):
    return rounded(tl.endpoint_baselines(ev), "median", "mad")


def tight_medians(spark, sf):
    """Medians per kind of event of values of which every one lies within a billionth of the others."""
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("tight", 1 + F.col("value") * 1e-12)
    found = medians(table, F.col("tight"), ["event_type"])
    return found.select("event_type", "n", ((F.col("median") - 1) * 1e12).alias("median"))


def anomaly_scores(ev):
    return tl.score(ev, tl.endpoint_baselines(ev)).select("idx", r6("anomaly_score").alias("anomaly_score"))


def top_anomalies(ev):
    found = tl.detect_anomalies(ev)
    return found.select("idx", "path", "status", r6("latency").alias("latency"), r6("anomaly_score").alias("anomaly_score"))


def clusters(ev):
    return rounded(tl.cluster_logs(ev).drop("key", "cluster", "tokens"), "avg_latency")


def assigned(ev):
    templates = materialize(tl.cluster_logs(ev), "templates")
    return tl.assign_templates(ev, templates).groupBy("cluster_id").agg(F.count("*").alias("n"))


def template_groups(ev):
    return grouped_messages(ev).groupBy("key").agg(F.count("*").alias("n"))


def conversation_templates(spark, sf):
    """Templates of chat turns: many words, many groups."""
    turns = fx.read_table(ready(spark), sf, "conversations")
    ev = turns.select(
        F.lit("chat").alias("source"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("idx"),
        F.col("text").alias("full_request"), F.lit(False).alias("is_error"), F.lit("INFO").alias("severity"),
        F.length("text").cast("double").alias("latency"),
    )
    found = all_templates(materialize(ev, "chat"))
    return found.select("key", "cluster", "template", "count", r6("avg_latency").alias("avg_latency"))


def mixed_templates(spark, sf):
    """Lines of nine formats, parsed, then the templates of their messages."""
    ev = tl.parse_logs(fx.mixed_lines(ready(spark), sf), context())
    found = all_templates(materialize(ev.drop("id"), "mixed"))
    return found.select("key", "cluster", "template", "count", "error_count", r6("avg_latency").alias("avg_latency"), "severity")


# -- streams -------------------------------------------------------------------------

def _event_stream(spark, sf):
    """log_events written to a folder and read back as a stream."""
    path = scratch_path(spark, "arrivals")
    fx.log_events(ready(spark), sf).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drain(spark, stream: DataFrame, name: str) -> DataFrame:
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def parse_stream(spark, sf):
    path = _written_lines(spark, sf)
    parsed = tl.parse_stream(tl.stream_lines(spark, path), "clf", context())
    return _drain(spark, parsed, "parsed").select(
        stamp().alias("time"), "method", "path", "status", r6("latency").alias("latency"), "remote_ip", "is_error"
    )


def parse_stream_mixed(spark, sf):
    """A stream settled on one format in which the other formats' lines turn up."""
    path = scratch_path(spark, "mixed-lines")
    fx.mixed_lines(ready(spark), sf).repartition(4).select("line").write.text(path)
    parsed = tl.parse_stream(tl.stream_lines(spark, path), "clf", context())
    return _drain(spark, parsed, "parsed").select(
        stamp().alias("time"), "method", "path", "status", r6("latency").alias("latency"), "is_error", "severity", "log_type"
    )


def _arrived(spark, path: str, **options) -> DataFrame:
    """Every file below `path` parsed in a stream that runs until there are no more, a few files an epoch."""
    folder = scratch_path(spark, "arrived")
    tl.parse_arrivals(spark, path, folder + "/events", folder + "/checkpoint", context(), availableNow=True, **options).awaitTermination()
    return spark.read.parquet(folder + "/events")


def stream_line_numbers(spark, sf):
    """Line numbers and ids of four files in a stream, every tenth line blank."""
    path = scratch_path(spark, "arrivals")
    part = F.col("event_id") % 4
    texts = fx.requests(ready(spark), sf).select(
        part.alias("part"), "event_id",
        F.when(F.col("event_id") % 40 < 4, " ").otherwise(F.concat_ws(" ", "method", "raw_path", "event_id")).alias("line"),
    )
    texts.repartition(4, "part").sortWithinPartitions("part", "event_id").select("part", "line").write.partitionBy("part").text(path)
    found = _arrived(spark, path, options={"maxFilesPerTrigger": "2"})
    return found.select(F.regexp_extract("source", r"part=(\d)", 1).cast("long").alias("part"), "idx", "id", "raw_line")


def stream_csv(spark, sf):
    """A plain and a W3C file in three chunks each, the header in the first alone, one chunk an epoch."""
    path = scratch_path(spark, "chunks")
    for chunk in range(3):
        for kind in ("csv", "w3c"):
            lines = fx.lines_of(ready(spark), sf, kind)
            size = F.ceil((F.lit(lines.agg(F.max("idx")).scalar()) + 1) / 3)
            mine = lines.filter(F.floor(F.col("idx") / size) == chunk)
            # One file a chunk, so that they arrive in order.
            mine.coalesce(1).sortWithinPartitions("idx").select("line").write.text(f"{path}/{kind}.log/{chunk}")
    found = _arrived(spark, path + "/*/*", chunk=r"/\d+/[^/]*$", options={"maxFilesPerTrigger": "1"})
    kind = F.regexp_extract("source", r"([a-z0-9]+)\.log$", 1)
    return event_view(found, kind.alias("kind"), "raw_line")


def negative_latency(ev):
    """A view in which half the latencies are below nothing, under a filter that doesn't name them."""
    odd = ev.withColumn("latency", F.when(F.col("idx") % 2 == 1, -F.col("latency")).otherwise(F.col("latency")))
    return tl.query_logs(odd, tl.LogQuery(methods=("GET",))).select("idx")


def search_accents(ev):
    said = F.concat(F.when(F.col("idx") % 3 == 0, "ÉCHEC ").otherwise("echec "), "raw_line")
    return tl.search(ev.withColumn("raw_line", said), r"(?<what>échec) get").select("idx")


def stats_bundle(ev):
    s = tl.aggregate_stats(ev)
    return rounded(s["kpis"].crossJoin(s["latency_percentiles"]), "avg_latency", "error_rate", "p50", "p90", "p95", "p99")


def windowed_signals(ev):
    out = tl.windowed_signals(ev, "1 hour")
    return rounded(out.withColumn("start", stamp("start")), "avg_latency", "p95_latency")


def score_stream(spark, sf):
    table = tl.endpoint_baselines(fx.log_events(ready(spark), sf))
    scored = tl.score_stream(_event_stream(spark, sf), table)
    return _drain(spark, scored, "scored").select("idx", "status", r6("anomaly_score").alias("anomaly_score"))


def stats_on_append(spark, sf):
    out = scratch_path(spark, "kpis")

    def report(s, epoch):
        s["kpis"].write.mode("overwrite").parquet(out)

    folder = scratch_path(spark, "stream")
    tl.stats_on_append(
        _event_stream(spark, sf), folder + "/events", folder + "/checkpoint", report, availableNow=True
    ).awaitTermination()
    return rounded(spark.read.parquet(out), "avg_latency", "error_rate")


def on_append(part: str, shape):
    """One statistic of a stream of four files, an epoch each, from the states of the last epoch."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "arrivals")
        fx.log_events(ready(spark), sf).repartition(4).write.parquet(path)
        schema = spark.read.parquet(path).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        folder, last = scratch_path(spark, "stream"), {}
        tl.stats_on_append(
            stream, folder + "/events", folder + "/checkpoint", lambda s, epoch: last.update(stats=s), availableNow=True
        ).awaitTermination()
        return shape(last["stats"][part])

    return run


def view_digest(ev):
    return tl.view_digest(ev, tl.LogQuery(methods=("GET",)), tl.aggregate_stats(ev, saved=True))


LOW_HIGH = tl.LogQuery(min_latency=20, max_latency=80)
COMBINED = tl.LogQuery(
    text="api/view", methods=("GET",), status_classes=("2xx", "5xx"), log_types=("HTTP",), max_latency=100, time_range="24H"
)

QUERIES = {
    "normalize_path": on_table("pages", normalize_path),
    "clf_path": on_table("pages", lambda p: p.select("page_id", fn.clf_path("url").alias("path"))),
    "short_path": on_table("pages", lambda p: p.select("page_id", fn.short_path("url").alias("short"))),
    "message_preview": on_table("documents", lambda d: d.select("doc_id", fn.message_preview("text").alias("preview"))),
    "log_template": on_table("documents", lambda d: d.select("doc_id", fn.log_template("text").alias("template"))),
    "log_id": on_table("pages", log_ids),
    "parse_date": parse_date,
    "epoch_time": epoch_time,
    "lenient_numbers": lenient_numbers,
    "record_labels": on_events(record_labels),
    "bucket_labels": on_events(bucket_labels),
    "token_algebra": on_events(token_algebra),
    "saturation": saturation,
    "scalar_payload": scalar_payload,
    "log_events": on_events(event_view),
    "filter_time_slice": on_events(ids_of(tl.LogQuery(time_range="24H"))),
    "filter_text": on_events(ids_of(tl.LogQuery(text="[DB] get"))),
    "filter_log_types": on_events(ids_of(tl.LogQuery(log_types=("DATABASE", "APP")))),
    "filter_methods": on_events(ids_of(tl.LogQuery(methods=("PUT", "POST")))),
    "filter_status_classes": on_events(ids_of(tl.LogQuery(status_classes=("5xx", "Error")))),
    "filter_latency": on_events(ids_of(LOW_HIGH)),
    "filter_combined": on_events(ids_of(COMBINED)),
    "search_regex": on_events(lambda ev: tl.search(ev, r"VIEW/1\d$", "CRITICAL").select("idx")),
    "search_substring": on_events(
        lambda ev: tl.search(ev.withColumn("raw_line", F.concat(F.lit("("), "raw_line")), "(get").select("idx")
    ),
    "available_methods": on_events(tl.available_methods),
    "kpis": on_events(lambda ev: rounded(stats.kpis(ev), "avg_latency", "error_rate")),
    "latency_percentiles": on_events(lambda ev: rounded(stats.latency_percentiles(ev), "p50", "p90", "p95", "p99")),
    "status_distribution": on_events(stats.status_distribution),
    "method_distribution": on_events(stats.method_distribution),
    "top_endpoints": on_events(lambda ev: rounded(stats.top_endpoints(ev), "avg_latency", "error_rate")),
    "top_endpoints_chart": on_events(lambda ev: rounded(stats.top_endpoints_chart(ev), "avg_latency", "error_rate")),
    "requests_over_time": on_events(lambda ev: rounded(stats.requests_over_time(ev), "avg_latency")),
    "golden_signals": on_events(lambda ev: rounded(stats.golden_signals(ev), "latency", "traffic", "errors", "saturation")),
    "latency_histogram": on_events(lambda ev: rounded(stats.latency_histogram(ev), "min")),
    "traffic_heatmap": on_events(lambda ev: rounded(stats.traffic_heatmap(ev), "error_rate")),
    "heatmap_intensity": on_events(lambda ev: rounded(stats.heatmap_intensity(ev), "intensity", "opacity", "height")),
    "view_digest": on_saved_events(view_digest),
    "endpoint_baselines": on_saved_events(baselines),
    "tight_medians": tight_medians,
    "anomaly_scores": on_saved_events(anomaly_scores),
    "detect_anomalies": on_saved_events(top_anomalies),
    "template_groups": on_events(template_groups),
    "cluster_logs": on_saved_events(clusters),
    "assign_templates": on_saved_events(assigned),
    "conversation_templates": conversation_templates,
    "mixed_templates": mixed_templates,
    **{f"parse_{k}": parse_kind(k) for k in (*fx.TEXT_KINDS, "json", "app_json", "csv", "w3c")},
    "parse_generic": parse_generic,
    "parse_mixed": parse_mixed,
    "parse_many_sources": parse_many_sources,
    "detect_format": detect_format,
    "read_lines": read_lines,
    "read_gzip_lines": read_gzip_lines,
    "save_and_load": saved_events,
    "saved_time_slice": saved_slice,
    "export_csv": exported_csv,
    "append": on_events(append),
    "append_ids": on_events(append_ids),
    "clear_events": cleared,
    "get_field": get_field,
    "json_documents": json_documents,
    "register_parser": registered_format,
    "parse_stream_mixed": parse_stream_mixed,
    "stream_line_numbers": stream_line_numbers,
    "stream_csv": stream_csv,
    "filter_negative_latency": on_events(negative_latency),
    "search_accents": on_events(search_accents),
    "aggregate_stats": on_events(stats_bundle),
    "retain_last": on_events(lambda ev: tl.retain_last(ev, 1000).select("idx")),
    "parse_stream": parse_stream,
    "windowed_signals": on_events(windowed_signals),
    "score_stream": score_stream,
    "stats_on_append": stats_on_append,
    "baselines_on_append": on_append("baselines", lambda b: rounded(b, "median", "mad").select("endpoint", "n", "median", "mad")),
    "anomalies_on_append": on_append(
        "anomalies", lambda a: rounded(a, "latency", "anomaly_score").select("idx", "path", "status", "latency", "anomaly_score")
    ),
    "requests_over_time_on_append": on_append("requests_over_time", lambda r: rounded(r, "avg_latency")),
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log lines → records → server errors → busiest endpoints."""
    clf = next(s for s in known_formats() if s.id == "clf")
    ev = tl.parse_with(clf, fx.lines_of(ready(spark), sf, "clf"), context())
    return stats.top_endpoints(tl.query_logs(ev, tl.LogQuery(status_classes=("5xx",))))
