import pytest
from pyspark.sql import functions as F

from helpers import lines
from tidelog import ParserSpec, parse_logs, register_parser
from tidelog.operators.detect import detect_format
from tidelog.parsers import ParseContext, parse_csv, parse_json
from tidelog.parsers.csv_lines import split_cells

W3C = "#Fields: date time c-ip cs-method cs-uri-stem sc-status time-taken"
W3C_ROW = "2024-08-03\t05:06:07\t192.0.2.9\tPATCH\t/depot/items\t202\t0.5"

ONE = {
    "http_object": (
        '{"severity":"NOTICE","timestamp":"2024-08-03T05:06:07.890Z","httpRequest":{"status":204,"requestMethod":"PATCH","requestUrl":"/warehouse/77/shelves","latency":"0.031s","remoteIp":"192.0.2.9"}}',
        dict(log_type="HTTP", method="PATCH", status=204, latency=31.0, is_error=False, path="/warehouse/:id/shelves", remote_ip="192.0.2.9"),
    ),
    "payload": (
        '{"level":"warning","time":"2024-08-03T05:06:08Z","jsonPayload":{"status":409,"request":"DELETE /carts/9"}}',
        dict(status=409, is_error=True, severity="WARN", method="DELETE", path="/carts/:id"),
    ),
    "clf": (
        '192.0.2.77 - kim [03/Aug/2024:05:06:07 +0000] "PUT /depot/41/items HTTP/2.0" 204 88 "https://shop.test/" "probe/2"',
        dict(log_type="HTTP", method="PUT", status=204, path="/depot/:id/items", remote_ip="192.0.2.77", is_error=False, body_bytes=88),
    ),
    "clf_time": (
        '198.18.4.5 - - [29/Feb/2024:23:59:58 +0000] "DELETE /sessions HTTP/1.0" 504 0 "-" "batch" 0.75',
        dict(status=504, is_error=True, severity="CRITICAL", latency=750.0, path="/sessions"),
    ),
    "alb": (
        '2024-08-03T05:06:07.000000Z app/edge/9f 192.0.2.8:5050 10.9.8.7:8443 0.010 0.250 0.005 301 302 12 34 "HEAD http://edge.test:80/maps/5 HTTP/1.1" "probe/2" ECDHE TLSv1.3',
        dict(log_type="HTTP", method="HEAD", status=302, latency=265.0, is_error=False),
    ),
    "alb_no_target": (
        '2024-08-03T05:06:09.000000Z app/edge/9f 192.0.2.8:5051 10.9.8.7:8443 0.004 -1 0.006 504 504 12 0 "POST http://edge.test:80/bulk HTTP/1.1" "probe/2" ECDHE TLSv1.3',
        dict(status=504, is_error=True, latency=10.0, upstream_latency=-1000.0),
    ),
    "envoy": (
        '[2024-08-03T05:06:09.100Z] "GET /stock/12 HTTP/2" 429 RL 64 0 37 2 "-" "probe/2" "req-5" "stock.test"',
        dict(status=429, is_error=True, latency=37.0, body_bytes=64, path="/stock/:id"),
    ),
    "java": (
        "2024-08-03 05:06:07.008  WARN 31 --- [worker-2] s.t.ShelfJob : Moved PUT /shelves/8 aside",
        dict(log_type="HTTP", method="PUT", path="/shelves/:id", severity="WARN"),
    ),
    "mongo": (
        "2024-08-03T05:06:07.008+0000 W COMMAND  [conn7] command shop.carts command: update { q: { n: 3 } } protocol:op_msg 88ms",
        dict(log_type="DATABASE", method="UPDATE", latency=88.0, severity="WARN", path="COMMAND"),
    ),
    "mongo_error": (
        "2024-08-03T05:06:10.000+0000 E NETWORK  [conn8] socket closed early",
        dict(log_type="DATABASE", severity="ERROR", is_error=True, latency=0.0),
    ),
    "redis": (
        "77:M 03 Aug 2024 05:06:07.008 # memory is nearly used up",
        dict(log_type="DATABASE", severity="WARN", full_request="memory is nearly used up"),
    ),
    "redis_child": ("78:C 03 Aug 2024 05:06:08.000 * snapshot finished", dict(log_type="UNKNOWN", path="raw_log")),
    "syslog": (
        "<13>Aug 13 05:06:07 node4 cron: POST /tick 202",
        dict(log_type="SYSTEM", method="SYSLOG", path="cron", status=202, is_error=False, remote_ip="node4"),
    ),
    "syslog_iso": (
        "<11>2024-08-03T05:06:07.008Z node4 queue[512]: worker lost, error 503",
        dict(log_type="SYSTEM", is_error=True, status=503),
    ),
    "k8s": (
        "2024-08-03T05:06:07.008Z stderr F E0803 05:06:07.008000 7 mounter.go:42] volume is missing",
        dict(severity="ERROR", is_error=True, path="mounter.go"),
    ),
    "postgres": (
        "2024-08-03 05:06:07.008 UTC [88] clerk@shop LOG: duration: 9.125 ms statement: DELETE FROM carts WHERE id = 4",
        dict(log_type="DATABASE", method="DELETE", path="carts", latency=9.125, is_error=False),
    ),
    "postgres_error": (
        "2024-08-03 05:06:09.000 UTC [89] clerk@shop ERROR: relation is missing",
        dict(log_type="DATABASE", severity="ERROR", is_error=True, latency=0.0),
    ),
    "w3c": (W3C + "\n" + W3C_ROW, dict(method="PATCH", status=202, path="/depot/items", latency=500.0)),
    "w3c_version": ("#Version: 1.0\n" + W3C + "\n" + W3C_ROW, dict(method="PATCH", status=202)),
}


@pytest.fixture(scope="module")
def parsed(spark):
    """All cases as one table of sources, parsed in one go."""
    table = None
    for name, (text, _) in ONE.items():
        mine = lines(spark, text, name)
        table = mine if table is None else table.unionByName(mine)
    rows = parse_logs(table.repartition(4)).drop("id").collect()
    return {r["source"]: r for r in rows}


@pytest.mark.parametrize("name", list(ONE))
def test_one_line_of_each_format(parsed, name):
    record = parsed[name].asDict()
    for field, value in ONE[name][1].items():
        assert record[field] == (pytest.approx(value) if isinstance(value, float) else value), field


def test_metadata(parsed):
    assert parsed["alb"]["metadata"] == {"source": "AWS_ALB", "elbStatus": "301"}
    assert parsed["syslog_iso"]["metadata"]["pid"] == "512"


def test_stack_trace_lines_are_generic_records(spark):
    text = (
        "2024-08-03 05:06:11.250 ERROR 31 --- [worker-9] s.t.ShelfJob : could not move\n"
        "\tat shop.ShelfJob.run(ShelfJob.java:8)"
    )
    # A tab in the first line only would make it a table; here it is in the second.
    rows = parse_logs(lines(spark, text)).orderBy("idx").collect()
    assert [(r["severity"], r["log_type"]) for r in rows] == [("ERROR", "APP"), ("INFO", "UNKNOWN")]


def test_json_drops_what_is_not_json(spark):
    text = '{"status":500}\nstatus 200\n{"status":200,"method":"GET"}\nnull\n{"a":1} x\n[1]'
    got = parse_json(lines(spark, text)).orderBy("idx").select("idx", "status", "log_type").collect()
    assert [tuple(r) for r in got] == [(0, 500, "HTTP"), (2, 200, "HTTP"), (5, 0, "APP")]


def test_json_null_hides_later_candidates(spark):
    text = "\n".join([
        '{"message":null,"msg":"GET /x","method":"PUT","url":"/y"}',
        '{"a":"x","message":"see GET /z","url":"/q"}',
        '{"latency":"142ms","level":"warning"}',
        '{"severity":"fatal","status":"404abc"}',
        '{"httpRequest.status":201,"ts":"1737124321","jsonPayload":null,"duration":0}',
        '{"ts":1737124321,"status":"0"}',
    ])
    got = parse_json(lines(spark, text), ParseContext(now=F.lit("2030-01-01").cast("timestamp"))).orderBy("idx").collect()
    assert (got[0]["full_request"], got[0]["path"]) == ("PUT /y", "/y")
    assert (got[1]["method"], got[1]["path"]) == ("MSG", "GET")
    assert (got[2]["latency"], got[2]["severity"]) == (142000.0, "WARN")
    assert (got[3]["severity"], got[3]["status"], got[3]["is_error"]) == ("FATAL", 404, True)
    assert got[4]["status"] == 201 and got[4]["timestamp"].year == 2030
    assert got[5]["timestamp"].year == 2025


def test_quoted_cells(spark):
    cases = {
        'a,"b,c",d': ["a", "b,c", "d"],
        '"say ""hi""", \'x\' ': ['say "hi"', "x"],
        '"",""""': ["", '"'],
        '"open,end': ["open,end"],
        'a""b,"x"y"z"': ["ab", "xyz"],
        "": [""],
    }
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = {r[0]: r[1] for r in df.select("line", split_cells(F.col("line"), F.lit(","))).collect()}
    assert got == cases


def test_csv_short_rows_and_late_comments(spark):
    text = "time,method,path,status,latency\n2024-08-03T05:06:07Z,GET,/a,200,5\nx\n#note\n2024-08-03T05:06:08Z,PUT,/b/7,503,6"
    plain = parse_csv(lines(spark, text)).orderBy("idx").collect()
    assert [(r["idx"], r["method"], r["path"], r["status"]) for r in plain] == [(1, "GET", "/a", 200), (4, "PUT", "/b/:id", 503)]

    # Record ids count records only, whether comments sit early or late.
    from tidelog.parsers import csv_lines

    early = {r["raw_line"]: r["id"] for r in plain}
    old, csv_lines.PREAMBLE_LINES = csv_lines.PREAMBLE_LINES, 0
    old_block, csv_lines.POSITION_BLOCK = csv_lines.POSITION_BLOCK, 2
    try:
        late = {r["raw_line"]: r["id"] for r in parse_csv(lines(spark, text)).collect()}
    finally:
        csv_lines.PREAMBLE_LINES, csv_lines.POSITION_BLOCK = old, old_block
    assert early == late


def test_w3c_day_only_when_strict(spark):
    text = W3C + "\n" + W3C_ROW
    combined, strict = (parse_csv(lines(spark, text), ParseContext(strict_w3c=s)).first()["timestamp"] for s in (False, True))
    assert (combined.hour, strict.hour) == (5, 0)


def test_detection(spark):
    cases = {
        "json": '{"code":201}\n{"code":404,"msg":"gone"}',
        "csv": W3C + "\n" + W3C_ROW,
        "clf": ONE["clf"][0],
        "none": "hello\nworld",
    }
    table = None
    for name, text in cases.items():
        table = lines(spark, text, name) if table is None else table.unionByName(lines(spark, text, name))
    got = {r["source"]: (r["format"], r["score"]) for r in detect_format(table).collect()}
    assert got == {"json": ("json", 1.0), "csv": ("csv", 1.0), "clf": ("clf", 1.0), "none": (None, 0.0)}


def test_registered_parser_wins_and_is_exclusive(spark):
    toy = ParserSpec(
        id="toy",
        exclusive=True,
        matches=lambda line: line.startswith("TOY "),
        fields=lambda line, groups: {"method": F.lit("TOY"), "path": F.substring(line, 5, 1000), "full_request": line},
    )
    unregister = register_parser(toy)
    try:
        rows = parse_logs(lines(spark, "TOY /crane\nTOY /b\nother")).orderBy("idx").collect()
        assert [(r["method"], r["path"]) for r in rows] == [("TOY", "/crane"), ("TOY", "/b")]
    finally:
        unregister()
    assert parse_logs(lines(spark, "TOY /crane")).first()["method"] == "MSG"


def test_wide_spaces_count_as_spaces(spark):
    text = ONE["clf"][0].replace("05:06:07 +", "05:06:07\u00a0+")
    assert "\u00a0" in text
    assert parse_logs(lines(spark, text)).first()["status"] == 204
    assert parse_logs(lines(spark, ONE["clf"][0] + " \u00e9")).first()["status"] == 204


def test_ids_of_formats_are_taken_once(spark):
    with pytest.raises(ValueError):
        register_parser(ParserSpec(id="json", matches=lambda line: F.lit(True), fields=lambda line, groups: {}))


def test_start_index_moves_places_and_ids(spark):
    text = ONE["clf"][0] + "\n" + ONE["clf"][0]
    whole = [(r["idx"], r["id"]) for r in parse_logs(lines(spark, text)).orderBy("idx").collect()]
    later = parse_logs(lines(spark, ONE["clf"][0]), ParseContext(start_index=1)).collect()
    assert [(r["idx"], r["id"]) for r in later] == whole[1:] and whole[0][1] != whole[1][1]


def test_one_document_a_line_whatever_the_session_says(spark):
    text = '{"a":1,"a":2,"status":201}\n{"status":1} {"status":2}\n{"status":3}}\n{"status":4}],[{}\n' + "{'status':5}\n" + '{"status":6,"t":"],["}'
    old = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    try:
        for value in ("true", "false"):
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", value)
            assert [r["status"] for r in parse_json(lines(spark, text)).orderBy("idx").collect()] == [201, 6]
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", old)
