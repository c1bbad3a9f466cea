import gzip
import zipfile

import pytest

from helpers import events
from tidelog import (
    LogQuery, clear_events, endpoint_baselines, export_csv, load_events, parse_stream, query_logs, read_lines,
    read_zip_lines, save_events, score_stream, stats_on_append, stream_lines, windowed_signals,
)
from tidelog.parsers import ParseContext


def in_order(df):
    return {k: [r["line"] for r in sorted(rows, key=lambda r: r["idx"])] for k, rows in by_source(df).items()}


def by_source(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["source"].rsplit("/", 1)[-1], []).append(r)
    return out


def test_line_index_over_many_blocks(spark, tmp_path):
    texts = {f"f{n}.log": [f"line {n} {i} " + "x" * (i % 50) for i in range(600)] for n in range(3)}
    for name, content in texts.items():
        mixed = "".join(line + ("\r\n" if i % 2 else "\n") + ("  \n" if i % 7 == 0 else "") for i, line in enumerate(content))
        (tmp_path / name).write_bytes(mixed.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert in_order(lines) == texts
        assert {k: sorted(r["idx"] for r in rows) for k, rows in by_source(lines).items()} == {k: list(range(600)) for k in texts}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write("one\n\ntwo\n")
    assert in_order(read_lines(spark, str(tmp_path))) == {"a.log.gz": ["one", "two"]}


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b/first.log", "one\n \ntwo\r\nthree")
        z.writestr("__MACOSX/first.log", "junk")
        z.writestr("b/", "")
        z.writestr("second.log", "four\n﻿five\n")
    got = read_zip_lines(spark, str(tmp_path / "a.zip")).collect()
    assert [r["line"] for r in sorted(got, key=lambda r: r["idx"])] == ["one", "two", "three", "four", "﻿five"]
    assert sorted(r["idx"] for r in got) == [0, 1, 2, 3, 4]


def test_save_load_clear(spark, tmp_path):
    path = str(tmp_path / "session")
    assert load_events(spark, path) is None
    save_events(events(spark, [{}, {}]), path, by_date=True)
    assert load_events(spark, path).count() == 2
    days = events(spark, [{"timestamp": "2025-01-15 10:00:00"}, {"timestamp": "2025-01-16 23:50:00"}, {"timestamp": "2025-01-17 00:10:00"}])
    save_events(days, path, by_date=True)
    hour = query_logs(load_events(spark, path), LogQuery(time_range="1H"))
    assert sorted(r["idx"] for r in hour.collect()) == [1, 2]
    scan = hour._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan and "date#" in scan
    clear_events(spark, path)
    assert load_events(spark, path) is None


def test_export(spark, tmp_path):
    path = str(tmp_path / "out")
    assert not export_csv(events(spark, [{}]).filter("idx > 3"), path)
    assert export_csv(events(spark, [{"full_request": 'say "hi", ok'}]).coalesce(1), path)
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "Timestamp,Severity,Method,Path,Status,Latency(ms),Message,UserAgent,RemoteIP"
    assert text[1] == '2025-01-17T14:32:00.000Z,INFO,GET,/api,200,10.0,"say ""hi"", ok",-,-'


CLF = '192.0.2.7 - - [03/Aug/2024:05:06:0{i} +0000] "GET /depot/{i} HTTP/1.1" {s} 12 "-" "ua" 0.{i}00'


def clf_file(folder, name, rows):
    (folder / name).write_text("".join(CLF.format(i=i, s=s) + "\n" for i, s in rows))


def test_stream_parse_and_stats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    clf_file(folder, "a.log", [(1, 200), (2, 500)])
    seen = {}

    def report(s, epoch):
        seen["kpis"] = tuple(s["kpis"].first())

    def run(**options):
        parsed = parse_stream(stream_lines(spark, str(folder)), "clf", ParseContext())
        stats_on_append(parsed, str(tmp_path / "table"), str(tmp_path / "cp"), report, **options, availableNow=True).awaitTermination()

    run()
    assert seen["kpis"][0] == 2 and seen["kpis"][3] == pytest.approx(50.0)
    clf_file(folder, "b.log", [(3, 200), (4, 200)])
    run()
    assert seen["kpis"][0] == 4 and seen["kpis"][3] == pytest.approx(25.0)
    clf_file(folder, "c.log", [(5, 404)])
    run(retain=3)
    assert seen["kpis"][0] == 3 and seen["kpis"][3] == pytest.approx(100 / 3)


def test_csv_is_not_streamed(spark, tmp_path):
    with pytest.raises(ValueError):
        parse_stream(stream_lines(spark, str(tmp_path)), "csv")


def test_stream_windows_and_scores(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [{"latency": 20.0, "timestamp": f"2025-01-17 14:3{i}:00"} for i in range(8)] + [
        {"latency": 5000.0, "timestamp": "2025-01-17 14:39:30"}
    ]
    ev = events(spark, rows)
    ev.write.parquet(path)
    stream = spark.readStream.schema(ev.schema).parquet(path)
    query = (
        windowed_signals(stream, "1 minute", "0 seconds").writeStream.format("memory").queryName("windows")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.sql("SELECT * FROM windows ORDER BY start").collect()
    assert len(got) == 9 and got[-1]["p95_latency"] == 5000.0

    scored = score_stream(stream, endpoint_baselines(ev))
    out = str(tmp_path / "scored")
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert [r["latency"] for r in spark.read.parquet(out).collect()] == [5000.0]


def test_no_line_is_lost_when_files_are_cut_differently(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.log").write_text("".join(f"{part} line {i}\n" + "\n" * (i % 7 == 0) for i in range(8000)))
    sizes = {"spark.sql.files.maxPartitionBytes": ("20000", "33000"), "spark.sql.leafNodeDefaultParallelism": ("2", "7")}
    try:
        for name, (first, _) in sizes.items():
            spark.conf.set(name, first)
        found = read_lines(spark, str(tmp_path / "in"))
        for name, (_, then) in sizes.items():
            spark.conf.set(name, then)
        got = sorted((r["source"][-5:], r["idx"], r["line"]) for r in found.collect())
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert got == [(f"{part}.log", i, f"{part} line {i}") for part in range(3) for i in range(8000)]


def test_stream_lines_of_other_formats_fall_through(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = [CLF.format(i=1, s=200), "\tat shop.ShelfJob.run(ShelfJob.java:8)", "77:M 03 Aug 2024 05:06:07.008 # memory is nearly used up"]
    (tmp_path / "in" / "a.log").write_text("\n".join(text) + "\n")
    parsed = parse_stream(stream_lines(spark, str(tmp_path / "in")), "clf", ParseContext())
    out = str(tmp_path / "out")
    parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sorted(r["log_type"] for r in spark.read.parquet(out).collect()) == ["DATABASE", "HTTP", "UNKNOWN"]
