import random

from helpers import events
from tidelog.operators import templates as T


def tokens_of(message):
    return message.split()[:40]


def prefix(token):
    import re

    for p in (r"^\d+(\.\d+)?$", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^\d{1,3}(\.\d{1,3}){3}$"):
        if re.match(p, token):
            return "<*>"
    return token


def sequential(rows, threshold=0.5):
    """The rule row by row, as a check on small inputs."""
    groups = {}
    for r in rows:
        tokens = tokens_of(r["full_request"])
        if not tokens:
            continue
        known = groups.setdefault(f"{len(tokens)}|{prefix(tokens[0])}", [])
        for c in known:
            agree = [x == y or "<*>" in (x, y) for x, y in zip(c["tokens"], tokens)]
            if sum(agree) / len(tokens) >= threshold:
                c["tokens"] = [x if x == y else "<*>" for x, y in zip(c["tokens"], tokens)]
                c["count"] += 1
                c["errors"] += r.get("is_error", False)
                if r["severity"] == "CRITICAL" or (r["severity"] == "ERROR" and c["severity"] == "INFO"):
                    c["severity"] = r["severity"]
                break
        else:
            known.append(dict(tokens=tokens, count=1, errors=int(r.get("is_error", False)), sample=r["full_request"], severity=r["severity"]))
    flat = [c for known in groups.values() for c in known]
    ordered = sorted(flat, key=lambda c: -c["count"])
    return [(" ".join(c["tokens"])[:150], c["sample"], c["count"], c["errors"], c["severity"]) for c in ordered]


def as_tuples(df):
    return [(r["template"], r["sample"], r["count"], r["error_count"], r["severity"]) for r in df.collect()]


def test_same_shape_is_one_template(spark):
    ev = events(spark, [{"full_request": f"GET /users/{i} HTTP/1.1"} for i in (1, 2, 99)])
    got = T.cluster_logs(ev).collect()
    assert [(r["template"], r["count"]) for r in got] == [("GET <*> HTTP/1.1", 3)]


def test_first_word_separates(spark):
    ev = events(spark, [{"full_request": "GET /users/1 HTTP/1.1"}, {"full_request": "POST /orders HTTP/1.1"}])
    assert T.cluster_logs(ev).count() == 2


def test_blank_messages_are_skipped(spark):
    ev = events(spark, [{"full_request": "  "}, {"full_request": " GET\u3000/a "}])
    assert [r["template"] for r in T.cluster_logs(ev).collect()] == ["GET /a"]


def random_rows(rng, n):
    words = ["a", "b", "c", "d", "e"]
    severities = ["INFO", "INFO", "WARN", "ERROR", "CRITICAL"]
    rows = []
    for _ in range(n):
        # One group holds most messages.
        size = rng.choice([4, 4, 4, 4, 3, 6])
        first = rng.choice(["x", "x", "x", "7", "10.0.0.1"])
        rows.append({
            "full_request": " ".join([first] + [rng.choice(words) for _ in range(size - 1)]),
            "severity": rng.choice(severities), "is_error": rng.random() < 0.3,
        })
    return rows


def test_parallel_rounds_give_the_sequential_outcome(spark):
    rng = random.Random(7)
    for n, block in ((300, 4), (120, 2), (400, 16)):
        rows = random_rows(rng, n)
        ev = events(spark, rows).repartition(5)
        got = as_tuples(T.cluster_logs(ev, k=1000, first_block=block))
        assert got == sequential(rows)


def test_assign_templates(spark):
    ev = events(spark, [{"full_request": m} for m in ("GET /a", "GET /b", "say hello there", "", "PUT /x y z")])
    templates = T.materialize(T.cluster_logs(ev.filter("idx < 3")), "templates")
    ids = {r["template"]: r["id"] for r in templates.collect()}
    got = [r["cluster_id"] for r in T.assign_templates(ev, templates).orderBy("idx").collect()]
    assert got == [ids["GET <*>"], ids["GET <*>"], ids["say hello there"], None, None]


def test_assignment_takes_the_first_of_many_templates(spark):
    rng = random.Random(3)
    ev = events(spark, random_rows(rng, 200) + [{"full_request": "x <*> c d"}, {"full_request": "<*> <*> <*>"}])
    templates = T.materialize(T.cluster_logs(ev, k=1000, first_block=8), "templates")
    known = sorted(((r["key"], r["cluster"], r["id"], r["tokens"]) for r in templates.collect()))
    for r in T.assign_templates(ev, templates).collect():
        tokens = tokens_of(r["full_request"])
        group = f"{len(tokens)}|{prefix(tokens[0])}"
        agreeing = [i for key, _, i, t in known if key == group and 2 * sum(x == y or "<*>" in (x, y) for x, y in zip(t, tokens)) >= len(tokens)]
        assert r["cluster_id"] == (agreeing[0] if agreeing else None)


def test_rounds_with_wildcards_in_messages(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 150)
    for r in rows[::7]:
        r["full_request"] = r["full_request"].replace("b", "<*>").replace("d", "<*>")
    assert as_tuples(T.cluster_logs(events(spark, rows), k=1000, first_block=3)) == sequential(rows)


def test_many_templates_in_one_group(spark):
    """100,000 messages of one group that share nothing but their first word, and as many like them."""
    n = 100_000
    lines = spark.range(2 * n).selectExpr("id AS idx", f"concat('job a', id % {n}, ' b', id % {n}, if(id < {n}, ' c', ' d'), id % {n}) AS full_request", "'s' AS source")
    log = T.learn_templates(lines, first_block=16_384)
    assert log.agg({"cluster": "max"}).first()[0] == n - 1 and log.count() == n + 2
    # Two of the later messages leave the first template nothing but its first word, so it takes the others.
    row = log.filter("cluster = 0").orderBy("since").collect()
    assert [(r["since"]["idx"], r["tokens"]) for r in row] == [(0, ["job", "a0", "b0", "c0"]), (n, ["job", "a0", "b0", "<*>"]), (n + 1, ["job", "<*>", "<*>", "<*>"])]
    assert [r["probes"] is None for r in row] == [False, False, True]


def test_groups_replayed_whole_are_not_looked_up(spark, monkeypatch):
    rng = random.Random(5)
    rows = [{"full_request": " ".join([rng.choice("xyz"), *rng.sample("abcdefghij", 5)]), "severity": "INFO"} for _ in range(60)]
    rows = list({r["full_request"]: r for r in rows}.values())
    looked_up, agreeing = [], T._agreeing

    def count(messages, versions, threshold):
        looked_up.append((messages.count(), versions.count()))
        return agreeing(messages, versions, threshold)

    monkeypatch.setattr(T, "_agreeing", count)
    assert as_tuples(T.cluster_logs(events(spark, rows), k=1000)) == sequential(rows)
    assert set(looked_up) == {(0, 0)}
    # A message that comes again may meet a later version, so its group is looked up.
    looked_up.clear()
    rows = rows + [r for r in rows if r["full_request"].startswith("x")]
    assert as_tuples(T.cluster_logs(events(spark, rows), k=1000)) == sequential(rows)
    assert looked_up[0][0] == len({r["full_request"] for r in rows if r["full_request"].startswith("x")})
