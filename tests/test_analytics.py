import random
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import events
from tidelog import (
    LogQuery, aggregate_stats, append, detect_anomalies, endpoint_baselines, query_logs, retain_last, score, search, view_digest,
)
from tidelog.operators import stats
from tidelog.operators.quantiles import medians, nearest_rank
from tidelog.plans import lookup
from tidelog.session import materialize


def test_slow_endpoint_is_no_anomaly_beside_a_fast_one(spark):
    rows = [{"path": "/health", "latency": 5.0}] * 8 + [{"path": "/checkout", "latency": 400.0}] * 8
    assert detect_anomalies(events(spark, rows)).count() == 0


def test_outlier_and_server_error_are_flagged(spark):
    rows = [{"latency": 20.0}] * 8 + [{"latency": 5000.0, "id": "slow"}, {"path": "/other", "status": 500, "id": "boom"}]
    assert [r["id"] for r in detect_anomalies(events(spark, rows)).collect()] == ["slow", "boom"]


def test_anomaly_scores_against_plain_medians(spark):
    rng = random.Random(3)
    rows = [{"path": rng.choice("aaaab"), "latency": round(rng.expovariate(0.02), 1)} for _ in range(500)]
    rows += [{"path": "two", "latency": x} for x in (1.0, 900.0)] + [{"path": "none", "latency": None, "status": 503}]
    ev = events(spark, rows)
    by_path = {}
    for r in rows:
        if r["latency"] is not None:
            by_path.setdefault(r["path"], []).append(r["latency"])
    want = {}
    for i, r in enumerate(rows):
        values = by_path.get(r["path"], [])
        want[i] = 0.0
        if len(values) >= 3:
            m = statistics.median(values)
            want[i] = 0.6745 * (r["latency"] - m) / statistics.median([abs(v - m) for v in values])
    got = {r["idx"]: r["anomaly_score"] for r in score(ev, endpoint_baselines(ev)).collect()}
    assert got == pytest.approx(want)


def test_join_beyond_the_broadcast_limit(spark, monkeypatch):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000).alias("k"))
    small = materialize(big.groupBy("k").agg(F.count("*").alias("n")), "small")
    want = sorted(map(tuple, big.join(small, "k").select("id", "n").collect()))
    for hot_fits in (True, False):
        answers = iter([False, hot_fits])
        monkeypatch.setattr(lookup, "fits_broadcast", lambda df: next(answers))
        got = lookup.lookup_join(big, small, ["k"], weight="n")
        assert sorted(map(tuple, got.select("id", "n").collect())) == want


def test_exact_quantiles(spark):
    rng = random.Random(5)
    shapes = {
        "one": [7.0], "pair": [1.0, 2.0], "same": [3.0] * 50, "mixed": [rng.gauss(0, 100) for _ in range(999)],
        "tight": [1 + i * 1e-12 for i in range(9000)], "far": [-1e308, 5e-324, 1e-310, 1e308, 0.0, -0.0],
        "wide": [10 ** rng.uniform(-3, 9) for _ in range(1000)], "ties": [float(rng.randint(-3, 3)) for _ in range(200)],
    }
    data = [(k, v) for k, values in shapes.items() for v in values] + [("mixed", None), ("mixed", float("nan"))]
    df = spark.createDataFrame(data, "k string, x double").repartition(6)
    got = {(r["k"], r["tag"]): r["v"] for r in nearest_rank(df, "x", [50, 90, 95, 99], ["k"]).collect()}
    for k, values in shapes.items():
        ordered = sorted(values)
        for p in (50, 90, 95, 99):
            assert got[k, float(p)] == ordered[max(0, -(-p * len(ordered) // 100) - 1)]
    middle = {r["k"]: (r["n"], r["median"]) for r in medians(df, F.col("x"), ["k"]).collect()}
    assert middle == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in shapes.items()}


def test_time_slice_and_filters(spark):
    ev = events(spark, [{"id": "old", "timestamp": "2025-01-17 14:00:00"}, {"id": "new"}, {"id": "p", "method": "POST", "latency": None}])
    assert {r["id"] for r in query_logs(ev, LogQuery(time_range="15M")).collect()} == {"new", "p"}
    assert [r["id"] for r in query_logs(ev, LogQuery(methods=("POST",))).collect()] == ["p"]
    # A record without latency passes every latency bound.
    assert [r["id"] for r in query_logs(ev, LogQuery(min_latency=50)).collect()] == ["p"]


def test_search(spark):
    ev = events(spark, [{"raw_line": "Hello (World"}, {"raw_line": "bye", "severity": "WARN"}])
    assert search(ev, "hello.*world").count() == 1
    assert search(ev, "(world").count() == 1
    assert search(ev, "", "WARN").count() == 1
    assert search(ev, "").count() == 2
    assert search(ev, r"(?<first>w)orld").count() == 1
    assert search(ev, r"(?P<first>w)orld").count() == 0
    assert search(events(spark, [{"raw_line": "ÉCHEC total"}]), "échec.*").count() == 1


def test_ranks_of_a_whole_table(spark):
    import math
    import random

    rng = random.Random(3)
    tight = [1 + i * 1e-12 for i in range(3000)]
    cases = [tight, [rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(3000)], [5.0] * 50, [float("inf"), -1.0, 0.0, -0.0, 2.0], [7.0]]
    for values in cases:
        df = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "x double")
        got = {r["tag"]: r["v"] for r in nearest_rank(df, "x", [0, 1, 50, 90, 99.5, 100]).collect()}
        want = sorted(values)
        assert got == {float(p): want[max(1, math.ceil(p / 100 * len(want))) - 1] for p in (0, 1, 50, 90, 99.5, 100)}
    assert nearest_rank(spark.createDataFrame([], "x double"), "x", [50]).collect() == []


def test_lower_bound_holds_as_soon_as_anything_is_asked_for(spark):
    ev = events(spark, [{"id": "n", "latency": -2000.0}, {"id": "z", "latency": 0.0}, {"id": "m", "latency": None}])
    ids = lambda q: sorted(r["id"] for r in query_logs(ev, q).collect())
    assert ids(LogQuery()) == ids(LogQuery(time_range="1H")) == ["m", "n", "z"]
    assert ids(LogQuery(methods=("GET",))) == ids(LogQuery(max_latency=5)) == ["m", "z"]


def test_append_and_retain(spark):
    a, b = events(spark, [{}, {}]), events(spark, [{"id": "b0"}, {"id": "b1"}])
    both = append(a, b)
    assert [r["idx"] for r in both.orderBy("idx").collect()] == [0, 1, 2, 3]
    # The same line gets another id further on.
    assert len({r["id"] for r in both.filter("idx >= 2").collect()}) == 2
    assert [r["idx"] for r in retain_last(both, 2).orderBy("idx").collect()] == [2, 3]
    assert [r["idx"] for r in append(a.filter("idx > 9"), b).orderBy("idx").collect()] == [0, 1]


def test_bundle(spark):
    ev = events(spark, [
        {"full_request": f"GET /api/users/{i}", "path": "/api/users/:id", "status": s, "timestamp": f"2025-01-17 14:32:0{i}"}
        for i, s in enumerate((200, 200, 500), 1)
    ])
    s = aggregate_stats(ev)
    assert s["clusters"].first()["template"] == "GET <*>"
    signals = s["golden_signals"].first()
    assert signals["saturation"] <= 100 and signals["traffic"] == pytest.approx(1.5)
    assert [r["status"] for r in s["anomalies"].collect()] == [500]
    assert [tuple(r) for r in s["requests_over_time"].select("time", "count").collect()][0] == ("2025-01-17 14:32:01", 1)
    digest = view_digest(ev, LogQuery(methods=("GET",), time_range="1H"), s).first()
    assert digest["error_rate"] == "33.33" and digest["top_endpoints"] == "GET /api/users/:id (33.3% errors)"
    assert digest["filters"].startswith('Time: 1H, Query: "None", Methods: GET')


def test_empty_view(spark):
    ev = events(spark, [{}]).filter("idx > 5")
    assert tuple(stats.kpis(ev).first()) == (0, 0.0, 0, 0.0)
    assert tuple(stats.latency_percentiles(ev).first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(stats.golden_signals(ev).first()) == (0.0, 0.0, 0.0, 0.0)
    assert stats.top_endpoints(ev).count() == 0 and stats.requests_over_time(ev).count() == 0
    assert stats.latency_histogram(ev).count() == 0
    assert stats.traffic_heatmap(ev).count() == 0 and stats.heatmap_intensity(ev).count() == 0


def test_histogram_and_heatmap_edges(spark):
    ev = events(spark, [{"latency": 0.0}] * 3)
    assert [r["count"] for r in stats.latency_histogram(ev).collect()][0] == 3
    ev = events(spark, [{"timestamp": "2025-01-17 23:30:00", "status": 500}])
    busy = {r["hour"]: r["error_rate"] for r in stats.traffic_heatmap(ev, "Europe/Berlin").collect() if r["count"]}
    assert busy == {0: 1.0}
    shown = stats.heatmap_intensity(ev).filter("hour = 23").first()
    assert (shown["intensity"], shown["has_errors"], shown["height"]) == (1.0, True, 100.0)


def test_hot_key_without_a_partner_is_split(spark):
    from pyspark.sql import functions as F

    from tidelog.plans.lookup import split_join

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        big = spark.range(60_000).repartition(6).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        small = spark.range(0, 60_000, 7).select(F.col("id").alias("key"), F.lit(1).alias("w"))
        joined = split_join(big, small, ["key"], "w", "left")
        rows = joined.agg(F.count("*"), F.count("w"), F.count_if(F.col("key") == -1), F.max(F.length("text")))
        assert tuple(rows.collect()[0]) == (60_000, sum(1 for i in range(0, 60_000, 7) if i % 3), 20_000, 64)
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
