"""Files that arrive in a stream against the same files read at once."""

import os

import pytest
from pyspark.sql import functions as F
from test_sources import CLF
from tidelog import parse_arrivals, parse_logs, read_lines
from tidelog.functions.ids import log_id
from tidelog.streaming import arrivals

CHUNK = r"\.\d+$"
PLAIN = ["time,method,path,status,latency"] + [f"2025-01-17T14:32:{i:02d}Z,GET,/a/{i},200,{i}" for i in range(40)]
W3C = ["#Version: 1.0", "#Fields: date time cs-method cs-uri-stem sc-status"]
W3C += [f"2025-01-17 14:32:{i % 60:02d} GET /w/{i} 404".replace(" ", "\t") for i in range(90)]


def arrive(folder, name, lines, at):
    """A file that came at second `at`."""
    file = folder / name
    file.write_text("".join(line + "\n" for line in lines))
    os.utime(file, (1_700_000_000 + at, 1_700_000_000 + at))


def stream(spark, tmp_path, **kw):
    table = str(tmp_path / "table")
    parse_arrivals(spark, str(tmp_path / "in"), table, str(tmp_path / "cp"), availableNow=True, **kw).awaitTermination()
    return spark.read.parquet(table)


def rows(events):
    return sorted(
        (r["source"].rsplit("/", 1)[1], r["idx"], r["id"], r["raw_line"], r["method"], r["path"], r["status"], r["log_type"])
        for r in events.collect()
    )


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "whole").mkdir()
    return tmp_path / "in", tmp_path / "whole"


def test_any_format_as_in_a_batch(spark, tmp_path, folders):
    arriving, _ = folders
    clf = [CLF.format(i=i, s=200) for i in range(30)]
    arrive(arriving, "a.log", [*clf[:10], "", " ", *clf[10:], "something else"], 0)
    arrive(arriving, "b.json", ['{"status":200,"method":"GET","path":"/x"}', "not json", '{"status":500,"method":"PUT","path":"/y"}'], 1)
    arrive(arriving, "c.csv", PLAIN, 2)
    arrive(arriving, "d.csv", W3C, 3)
    want = rows(parse_logs(read_lines(spark, str(arriving))))
    assert rows(stream(spark, tmp_path, options={"maxFilesPerTrigger": "2"})) == want
    assert len(want) == 31 + 2 + 40 + 90


def test_chunks_continue_each_other_across_restarts(spark, tmp_path, folders, monkeypatch):
    monkeypatch.setattr(arrivals, "FOLD", 2)
    arriving, whole = folders
    # Comments in the preamble, right behind a cut, and beyond the lines remembered one by one.
    w3c = [*W3C[:40], "# turned over", *W3C[40:80], "# and again", *W3C[80:]]
    arrive(whole, "p.csv", PLAIN, 0)
    arrive(whole, "w.csv", w3c, 0)
    want = rows(parse_logs(read_lines(spark, str(whole))))

    arrive(arriving, "p.csv.1", PLAIN[:10], 1)
    arrive(arriving, "w.csv.1", w3c[:40], 2)
    arrive(arriving, "w.csv.2", w3c[40:81], 3)
    stream(spark, tmp_path, chunk=CHUNK, options={"maxFilesPerTrigger": "1"})
    arrive(arriving, "w.csv.3", w3c[81:], 4)
    arrive(arriving, "p.csv.2", PLAIN[10:11], 5)
    arrive(arriving, "p.csv.3", PLAIN[11:], 6)
    got = stream(spark, tmp_path, chunk=CHUNK, options={"maxFilesPerTrigger": "1"})
    assert rows(got) == want


def test_chunks_of_one_epoch_follow_their_names(spark, tmp_path, folders):
    arriving, whole = folders
    arrive(whole, "p.csv", PLAIN, 0)
    for n, part in enumerate((PLAIN[:5], PLAIN[5:20], PLAIN[20:])):
        arrive(arriving, f"p.csv.{n}", part, 0)
    assert rows(stream(spark, tmp_path, chunk=CHUNK)) == rows(parse_logs(read_lines(spark, str(whole))))


def test_late_header_renames_from_its_epoch_on(spark, tmp_path, folders):
    arriving, _ = folders
    arrive(arriving, "p.csv.1", ["time,method,path,status", "2025-01-17T14:32:01Z,GET,/a,200", "2025-01-17T14:32:02Z,GET,/b,200"], 0)
    arrive(arriving, "p.csv.2", ["#Fields: status path method", "404,/c,PUT"], 1)
    arrive(arriving, "p.csv.3", ["500,/d,POST"], 2)
    got = rows(stream(spark, tmp_path, chunk=CHUNK, options={"maxFilesPerTrigger": "1"}))
    assert [(r[1], r[4], r[5], r[6]) for r in got] == [(1, "GET", "/a", 200), (2, "GET", "/b", 200), (4, "PUT", "/c", 404), (5, "POST", "/d", 500)]
    # The four records are numbered on without a gap or a repeat.
    ids = [spark.range(1).select(log_id(F.lit(r[3]), F.lit(n).cast("bigint"))).first()[0] for n, r in enumerate(got)]
    assert [r[2] for r in got] == ids


def test_missing_header_takes_the_first_line(spark, tmp_path, folders):
    arriving, whole = folders
    body = [f"x\tstatus\t{i}" for i in range(4)]
    arrive(arriving, "t.tsv.1", body[:2], 0)
    arrive(arriving, "t.tsv.2", body[2:], 1)
    arrive(whole, "t.tsv", body, 0)
    got = rows(stream(spark, tmp_path, chunk=CHUNK, options={"maxFilesPerTrigger": "1"}))
    assert got == rows(parse_logs(read_lines(spark, str(whole)))) and len(got) == 3
