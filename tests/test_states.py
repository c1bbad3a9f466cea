"""Reports from merged states against the same statistics of all rows."""

import random

import pytest
from helpers import events

from tidelog import aggregate_stats, endpoint_baselines
from tidelog.plans.states import MergedStats, States, _low_bit, _nodes

ORDERED = ("top_endpoints", "anomalies", "requests_over_time", "latency_histogram", "traffic_heatmap")


def rows_of(df):
    rows = [tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()]
    return rows


def some_rows(seed, n, idx, days):
    r = random.Random(seed)
    out = []
    for i in range(n):
        status = r.choice([200, 200, 201, 404, 500, 503])
        out.append({
            "idx": idx + i,
            "path": r.choice(["/a", "/b", f"/c{r.randrange(4)}"]),
            "method": r.choice(["GET", "POST"]),
            "status": status,
            "log_type": r.choice(["HTTP", "HTTP", "APP", "DATABASE"]),
            "latency": r.choice([None, 5.0, 10.0, 11.5, r.uniform(0, 90), r.uniform(500, 900)]),
            "body_bytes": r.randrange(1000),
            "timestamp": f"2025-01-{10 + r.randrange(days):02d} {r.randrange(24) if days > 1 else 14:02d}:{r.randrange(60):02d}:{r.randrange(60):02d}",
        })
    return out


def test_nodes_cover_each_epoch_once():
    for last in range(1, 70):
        covered = [e for n in _nodes(last) for e in range(n - _low_bit(n) + 1, n + 1)]
        assert sorted(covered) == list(range(1, last + 1))
        assert len(_nodes(last)) <= last.bit_length()
        # A node is made of its own epoch and whole earlier nodes.
        inner = _nodes(last - 1, last - _low_bit(last))
        covered = [e for n in inner for e in range(n - _low_bit(n) + 1, n + 1)]
        assert sorted([*covered, last]) == list(range(last - _low_bit(last) + 1, last + 1))


@pytest.mark.parametrize("skipped", [(), (0, 1)])
def test_reports_equal_those_of_all_rows(spark, tmp_path, skipped):
    table = str(tmp_path / "table")
    states, rows = States(spark, table), []
    # From seconds over minutes to days, an empty epoch in between; labels get coarser on the way.
    for epoch, (n, days) in enumerate([(30, 1), (0, 1), (200, 1), (90, 3), (40, 20)]):
        new = some_rows(epoch, n, len(rows), days)
        if epoch == 0:
            new = [{**r, "timestamp": f"2025-01-10 14:30:{i:02d}"} for i, r in enumerate(new)]
        rows += new
        events(spark, new).write.parquet(f"{table}/epoch={epoch}")
        if epoch in skipped:
            continue
        states.add(epoch)
        if epoch == 3:
            states.add(epoch)  # run again after a failure
        if epoch != 4 and (skipped or epoch != 2):
            continue
        merged = MergedStats(states, epoch)
        batch = aggregate_stats(events(spark, rows), saved=True)
        assert set(batch.names()) < set(merged.names())
        for name in batch.names():
            if name == "clusters":  # reads the events in either form
                continue
            assert merged[name].columns == batch[name].columns, name
            got, want = rows_of(merged[name]), rows_of(batch[name])
            assert got == want if name in ORDERED else sorted(got) == sorted(want), (epoch, name)
        baselines = rows_of(endpoint_baselines(events(spark, rows)))
        assert sorted(rows_of(merged["baselines"])) == sorted(baselines)


def test_reports_read_no_events(spark, tmp_path):
    table = str(tmp_path / "table")
    states = States(spark, table)
    for epoch in range(3):
        events(spark, some_rows(epoch, 40, 40 * epoch, 2)).write.parquet(f"{table}/epoch={epoch}")
        states.add(epoch)
    merged = MergedStats(states, 2)
    for name in merged.names():
        if name != "clusters":
            files = merged[name].inputFiles()
            assert not [f for f in files if "/table/epoch=" in f], name


def test_no_events_at_all(spark, tmp_path):
    table = str(tmp_path / "table")
    events(spark, []).write.parquet(f"{table}/epoch=0")
    states = States(spark, table)
    states.add(0)
    merged, batch = MergedStats(states, 0), aggregate_stats(events(spark, []), saved=True)
    for name in set(batch.names()) - {"clusters"}:
        assert rows_of(merged[name]) == rows_of(batch[name]), name


def test_an_endpoint_with_few_distinct_times(spark, tmp_path):
    """Counts stand for rows: medians of a concentrated distribution, far more rows than are put in order."""
    table = str(tmp_path / "table")
    base = events(spark, [{"latency": 7.0}])
    many = base.selectExpr("*", "explode(sequence(1, 20000)) AS k").selectExpr(
        *[c for c in base.columns if c not in ("latency", "idx")], "CAST(k AS bigint) AS idx", "CAST(k % 3 AS double) AS latency"
    ).select(*base.columns)
    for epoch in range(2):
        many.write.parquet(f"{table}/epoch={epoch}")
        states = States(spark, table)
        states.add(epoch)
    got = MergedStats(states, 1)["baselines"].first()
    assert (got["n"], got["median"], got["mad"]) == (40000, 1.0, 1.0)
