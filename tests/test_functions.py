import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn


def evaluate(spark, c):
    return spark.range(1).select(c).first()[0]


def reference_hash(line, index):
    h = 2166136261
    units = f"{index}:{line}".encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i:i + 2], "little")) * 16777619) & 0xFFFFFFFF
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "log-" + (digits or "0")


def test_log_id(spark):
    texts = ["GET /x", "", "é ü", "smile 😀", "a" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["id"] for r in df.select("i", fn.log_id("t", "i").alias("id")).collect()}
    assert got == {i: reference_hash(t, i) for i, t in enumerate(texts)}


@pytest.mark.parametrize("request_line, method, path", [
    ("GET /users/1/2/3 HTTP/1.1", "GET", "/users/:id/2/:id"),
    ("get /a?b=1", "MSG", "/a"),
    ("/only", "MSG", "/only"),
    ("-", "UNKNOWN", "UNKNOWN"),
    ("", "UNKNOWN", "UNKNOWN"),
    ("GET /f/0123456789abcdef0123456789abcdef/x", "GET", "/f/:uuid/x"),
])
def test_normalize_path(spark, request_line, method, path):
    r = evaluate(spark, fn.normalize_path(F.lit(request_line)))
    assert (r["method"], r["path"]) == (method, path)


def test_bucket_labels(spark):
    t = F.lit("2025-01-17 14:38:01").cast("timestamp")
    labels = [evaluate(spark, fn.bucket_label(t, F.lit(ms))) for ms in (30_000, 3_600_000, 86_400_000, 10**9)]
    assert labels == ["2025-01-17 14:38:01", "2025-01-17 14:38", "2025-01-17 14:30", "2025-01-17 14:00"]


def test_saturation(spark):
    def s(traffic, p50, p95, errors):
        return evaluate(spark, fn.saturation(*map(lambda x: F.lit(float(x)), (traffic, p50, p95, errors))))

    assert s(80, 10, 12, 0) < 80
    assert s(2, 20, 200, 20) > s(2, 20, 22, 0)
    assert s(10**9, 0, 10**9, 100) <= 100


def test_similarity_and_merge(spark):
    a, b = F.array(*map(F.lit, ["x", "1", "<*>"])), F.array(*map(F.lit, ["x", "2", "z"]))
    assert evaluate(spark, fn.token_similarity(a, b)) == pytest.approx(2 / 3)
    assert evaluate(spark, fn.merge_tokens(a, b)) == ["x", "<*>", "<*>"]
    assert evaluate(spark, fn.token_similarity(a, F.array(F.lit("x")))) == 0


def test_robust_z_on_flat_baseline(spark):
    def z(x, median, mad):
        return evaluate(spark, fn.robust_z(*map(lambda v: F.lit(float(v)), (x, median, mad))))

    assert z(5000, 20, 0) == 10 and z(60, 20, 0) == 0 and z(30, 20, 10) == pytest.approx(0.6745)


def test_scalar_metadata(spark):
    v = F.parse_json(F.lit('{"a":1,"b":null,"c":{"d":1},"e":"t","f":[1],"g":true}'))
    assert evaluate(spark, fn.scalar_payload(v)) == {"a": "1", "e": "t", "g": "true"}
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert evaluate(spark, fn.scalar_metadata(m)) == {"a": "1"}
