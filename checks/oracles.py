"""The same results in SQL, straight from the driver's tables."""

from __future__ import annotations

from tidelog.fixtures import TEXT_KINDS

NOW = "2030-01-01 00:00:00.000"

# Requests and log records, by the rule the fixtures follow.
LOG = r"""
WITH r AS (
  SELECT event_id, date_trunc('millisecond', ts) AS ts, user_id, event_type, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
         CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS segment,
         CASE WHEN event_type IN ('click', 'signup') THEN 'POST' WHEN event_type = 'purchase' THEN 'PUT' ELSE 'GET' END AS method
  FROM events
), s AS (
  SELECT *, '/api/' || segment || '/' || user_id AS raw_path, '/api/' || segment || '/:id' AS path,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END
              WHEN event_type = 'signup' THEN 201
              WHEN event_type = 'purchase' AND k % 10 = 0 THEN 302 ELSE 200 END AS status
  FROM r
), log AS (
  SELECT event_id AS idx, event_id, ts, user_id, segment, method, raw_path, path, status, value AS latency,
         method || ' ' || raw_path AS full_request, status >= 400 AS is_error,
         CASE WHEN status >= 500 THEN 'CRITICAL' WHEN status >= 400 THEN 'ERROR' ELSE 'INFO' END AS severity,
         CASE event_id % 20 WHEN 7 THEN 'DATABASE' WHEN 8 THEN 'SYSTEM' WHEN 9 THEN 'APP' ELSE 'HTTP' END AS log_type,
         CAST(k * 100 AS BIGINT) AS body_bytes, 'ua/' || (user_id % 5) AS user_agent, '10.0.0.' || (user_id % 250) AS remote_ip,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ms_time, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' AS s_time,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS ms_text, CAST(round(value, 0) AS BIGINT) AS whole_ms
  FROM s
), labelled AS (
  SELECT *, CASE WHEN log_type = 'HTTP' THEN CAST(status // 100 AS VARCHAR) || 'xx' WHEN is_error THEN 'Error' ELSE 'Success' END AS status_class,
         CASE log_type WHEN 'DATABASE' THEN '[DB] ' || method || ' ' || path WHEN 'SYSTEM' THEN '[SYS] ' || path
              WHEN 'APP' THEN '[APP] ' || method || ' ' || path ELSE method || ' ' || path END AS label,
         method || ' ' || path AS endpoint
  FROM log
)
"""

BASELINES = """
, med AS (SELECT endpoint, count(*) AS n, quantile_cont(latency, 0.5) AS median FROM labelled GROUP BY endpoint),
base AS (
  SELECT l.endpoint, any_value(m.n) AS n, any_value(m.median) AS median, quantile_cont(abs(l.latency - m.median), 0.5) AS mad
  FROM labelled l JOIN med m ON l.endpoint = m.endpoint GROUP BY l.endpoint
), scored AS (
  SELECT l.*, CASE WHEN b.n < 3 THEN 0 WHEN b.mad < 1e-6
                   THEN CASE WHEN l.latency > greatest(b.median * 5, b.median + 50) THEN 10 ELSE 0 END
                   ELSE 0.6745 * (l.latency - b.median) / b.mad END AS score
  FROM labelled l JOIN base b ON l.endpoint = b.endpoint
), flagged AS (SELECT * FROM scored WHERE status >= 500 OR (score > 3 AND latency > 50))
"""


def fnv(text: str) -> str:
    """Record id of an SQL text expression (already `index:line`)."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    mixed = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    return f"'log-' || lower(to_base({mixed}, 36))"


SPACES = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def path_sql(raw: str, uuid: bool = True) -> str:
    out = f"split_part({raw}, '?', 1)"
    if uuid:
        out = rf"regexp_replace({out}, '/([0-9a-fA-F-]{{32,}}|[0-9a-fA-F-]{{36}})(/|$)', '/:uuid\2', 'g')"
    return rf"regexp_replace({out}, '/(\d+)(/|$)', '/:id\2', 'g')"


def record(**columns: str) -> str:
    """Select list of a parsed record; what is not given has its neutral value."""
    full = {
        "idx": "idx", "time": "ms_time", "method": "method", "path": "path", "full_request": "full_request",
        "status": "status", "latency": "round(latency, 6)", "upstream_latency": "CAST(0 AS DOUBLE)", "user_agent": "'-'",
        "remote_ip": "'-'", "referer": "'-'", "is_error": "is_error", "severity": "severity", "log_type": "'HTTP'",
        "body_bytes": "CAST(0 AS BIGINT)", **columns,
    }
    return ", ".join(f"{sql} AS {name}" for name, sql in full.items())


FLAT = "CASE WHEN is_error THEN 'ERROR' ELSE 'INFO' END"
ZERO = "CAST(0 AS DOUBLE)"
PARSED = {
    "clf": dict(time="s_time", user_agent="user_agent", remote_ip="remote_ip", body_bytes="body_bytes"),
    "alb": dict(full_request="full_request || ' HTTP/1.1'", upstream_latency="round(latency, 6)", user_agent="user_agent"),
    "envoy": dict(latency="CAST(whole_ms AS DOUBLE)", upstream_latency="CAST(3 AS DOUBLE)", user_agent="user_agent", body_bytes="body_bytes"),
    "java": dict(full_request="'Handled ' || full_request || ' status ' || status", status="0", latency=ZERO, severity=FLAT),
    "mongo": dict(
        path="'COMMAND'", status="0", latency="CAST(whole_ms AS DOUBLE)", severity=FLAT, log_type="'DATABASE'",
        full_request="'command db.' || segment || ' command: ' || lower(method) || ' { q: 1 } protocol:op_msg ' || whole_ms || 'ms'",
    ),
    "redis": dict(
        method="'REDIS'", path="'server'", status="0", latency=ZERO, is_error="false", log_type="'DATABASE'",
        severity="CASE WHEN is_error THEN 'WARN' ELSE 'INFO' END", full_request="full_request || ' took ' || ms_text",
    ),
    "syslog": dict(
        method="'SYSLOG'", path="'web'", latency=ZERO, remote_ip="remote_ip", severity=FLAT, log_type="'SYSTEM'",
        full_request="full_request || ' ' || status",
    ),
    "k8s": dict(
        method="'LOG'", path="segment || '.go'", latency="CAST(whole_ms AS DOUBLE)", is_error="status >= 500",
        severity="CASE WHEN status >= 500 THEN 'ERROR' ELSE 'INFO' END",
        full_request="'I0101 1 ' || segment || '.go:1] ' || full_request || ' ' || status || ' ' || whole_ms || 'ms'",
    ),
    "postgres": dict(
        method="'SELECT'", path="segment", status="0", user_agent="'Postgres ' || user_id", severity=FLAT, log_type="'DATABASE'",
        full_request="'duration: ' || ms_text || ' ms statement: SELECT * FROM ' || segment",
    ),
    "json": dict(user_agent="user_agent", remote_ip="remote_ip", body_bytes="body_bytes"),
    "app_json": dict(severity=FLAT),
    "csv": dict(idx="idx + 1"),
    "w3c": dict(idx="idx + 2", time="s_time"),
}


def mixed() -> str:
    names = ["idx", "time", "method", "path", "status", "latency", "is_error", "severity", "log_type"]
    parts = [
        f"SELECT {', '.join(names)} FROM (SELECT {record(**PARSED[kind])}, idx AS turn FROM log) WHERE turn % {len(TEXT_KINDS)} = {place}"
        for place, kind in enumerate(TEXT_KINDS)
    ]
    return LOG + " UNION ALL ".join(parts)


def templates(messages: str) -> str:
    """The template rule by its definition: each group's messages in order, one step of the recursion each.

    `messages`: idx, full_request, latency, is_error, severity.
    """
    agree = "list_transform(list_zip(t, tokens), lambda z: CAST(z[1] = z[2] OR z[1] = '<*>' OR z[2] = '<*>' AS INTEGER))"
    merged = "list_transform(list_zip(t, tokens), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END)"
    wild = (
        r"regexp_matches(tokens[1], '^\d+(\.\d+)?$') OR regexp_matches(tokens[1], '^\d{1,3}(\.\d{1,3}){3}$') OR "
        r"regexp_matches(tokens[1], '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')"
    )
    return f"""WITH RECURSIVE said AS ({messages}),
        cut AS (SELECT *, regexp_extract_all(full_request, '[^{SPACES}]+')[1:40] AS tokens FROM said),
        keyed AS (SELECT *, len(tokens) || '|' || CASE WHEN {wild} THEN '<*>' ELSE tokens[1] END AS key FROM cut WHERE len(tokens) > 0),
        m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS k FROM keyed),
        step AS (
          SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[][]) AS state, CAST(0 AS BIGINT) AS cluster FROM m
          UNION ALL
          SELECT key, k, CASE WHEN hit = 0 THEN list_append(state, tokens)
              ELSE state[1:hit - 1] || [list_extract(list_transform(state[hit:hit], lambda t: {merged}), 1)] || state[hit + 1:] END,
            CASE WHEN hit = 0 THEN len(state) ELSE hit - 1 END
          FROM (SELECT s.key, m.k, s.state, m.tokens,
              coalesce(list_position(list_transform(s.state, lambda t: list_sum({agree}) >= 0.5 * len(tokens)), true), 0) AS hit
            FROM step s JOIN m ON m.key = s.key AND m.k = s.k + 1)
        ),
        last AS (SELECT key, arg_max(state, k) AS state FROM step GROUP BY key)
        SELECT m.key, CAST(s.cluster AS INTEGER) AS cluster,
          substring(array_to_string(any_value(l.state)[s.cluster + 1], ' '), 1, 150) AS template, count(*) AS count,
          count(*) FILTER (m.is_error) AS error_count, round(avg(m.latency), 6) AS avg_latency,
          CASE WHEN bool_or(m.severity = 'CRITICAL') THEN 'CRITICAL'
            WHEN arg_min(m.severity, m.idx) = 'INFO' AND bool_or(m.severity = 'ERROR') THEN 'ERROR'
            ELSE arg_min(m.severity, m.idx) END AS severity
        FROM m JOIN step s ON s.key = m.key AND s.k = m.k JOIN last l ON l.key = m.key GROUP BY m.key, s.cluster"""


def mixed_messages() -> str:
    parts = [
        f"SELECT idx, full_request, latency, is_error, severity FROM (SELECT {record(**PARSED[kind])}, idx AS turn FROM log) WHERE turn % {len(TEXT_KINDS)} = {place}"
        for place, kind in enumerate(TEXT_KINDS)
    ]
    return LOG + " UNION ALL ".join(parts)


def mixed_stream() -> str:
    return f"SELECT * EXCLUDE (idx) FROM ({mixed()})"


def streamed_csv() -> str:
    """Parsed records of both delimited files with the ids their lines have, numbered without headers."""
    lines = {
        "csv": """strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z,' || method || ',"' || raw_path || '",' || status || ',' || ms_text
            || ',"said ""hi"", ok"'""",
        "w3c": """strftime(ts, '%Y-%m-%d') || chr(9) || strftime(ts, '%H:%M:%S') || chr(9) || method || chr(9) || raw_path || chr(9)
            || status || chr(9) || CAST(CAST(latency / 1000 AS DECIMAL(18,5)) AS VARCHAR)""",
    }
    parts = [
        f"SELECT {record(**PARSED[kind])}, '{kind}' AS kind, {text} AS raw_line, {fnv(f'event_id || {chr(39)}:{chr(39)} || ({text})')} AS id FROM log"
        for kind, text in lines.items()
    ]
    return LOG + " UNION ALL ".join(parts)


def many_sources() -> str:
    rows = {"clf": "is_error", "json": "is_error", "csv": "is_error", "w3c": "is_error", "k8s": "status >= 500"}
    return LOG + " UNION ALL ".join(
        f"SELECT '{kind}.log' AS source, count(*) AS n, count(*) FILTER ({bad}) AS errors, CAST(sum(status) AS BIGINT) AS status_sum, "
        f"CAST(sum({'3' if kind == 'k8s' else 'length(method)'}) AS BIGINT) AS method_chars FROM log"
        for kind, bad in rows.items()
    )


VIEW = (
    "SELECT idx, " + fnv("idx || ':' || full_request") + " AS id, ms_time AS time, method, path, full_request, status, "
    "round(latency, 6) AS latency, CAST(0 AS DOUBLE) AS upstream_latency, user_agent, remote_ip, '-' AS referer, is_error, "
    "severity, log_type, body_bytes FROM log"
)
NEWEST = "(SELECT max(ts) FROM log)"
KPIS = (
    "SELECT count(*) AS total_requests, round(avg(latency), 6) AS avg_latency, CAST(sum(body_bytes) AS BIGINT) AS total_bytes, "
    "round(100.0 * count(*) FILTER (is_error) / count(*), 6) AS error_rate FROM log"
)
ENDPOINTS = (
    "SELECT label AS path, count(*) AS count, round(avg(latency), 6) AS avg_latency, "
    "round(100.0 * count(*) FILTER (is_error) / count(*), 6) AS error_rate{extra} "
    "FROM labelled GROUP BY label ORDER BY count(*) DESC, min(idx) LIMIT {k}"
)
HOURS = (
    "SELECT CAST(h.hour AS INTEGER) AS hour, count(l.idx) AS count, "
    "CASE WHEN count(l.idx) > 0 THEN CAST(count(*) FILTER (l.is_error) AS DOUBLE) / count(l.idx) ELSE 0 END AS error_rate "
    "FROM range(24) h(hour) LEFT JOIN log l ON hour(l.ts) = h.hour GROUP BY h.hour"
)
CLUSTERS = (
    ", c AS (SELECT method, CASE WHEN count(DISTINCT raw_path) > 1 THEN method || ' <*>' ELSE min(full_request) END AS template, "
    "arg_min(full_request, idx) AS sample, count(*) AS count, count(*) FILTER (is_error) AS error_count, "
    "round(avg(latency), 6) AS avg_latency, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' "
    "WHEN arg_min(severity, idx) = 'INFO' AND bool_or(severity = 'ERROR') THEN 'ERROR' ELSE arg_min(severity, idx) END AS severity, "
    "min(idx) AS seen FROM log GROUP BY method) "
)
LINE_REPORT = "SELECT count(*) AS lines, CAST(4 AS BIGINT) AS files_from_zero, CAST(4 AS BIGINT) AS files_without_gap FROM events"
FNV_TEMPLATE = fnv("'0:' || template")

ORACLES = {
    "normalize_path": f"SELECT page_id, 'GET' AS method, {path_sql('url')} AS path FROM pages",
    "clf_path": f"SELECT page_id, {path_sql('url', uuid=False)} AS path FROM pages",
    "short_path": "SELECT page_id, CASE WHEN length(url) > 30 THEN '...' || right(url, 30) ELSE url END AS short FROM pages",
    "message_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents",
    "log_template": f"SELECT doc_id, substring(array_to_string(regexp_extract_all(text, '[^{SPACES}]+')[1:40], ' '), 1, 150) AS template FROM documents",
    "log_id": f"SELECT page_id, {fnv('''page_id || ':' || url''')} AS id FROM pages",
    "parse_date": LOG + f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN s_time WHEN 4 THEN s_time WHEN 5 THEN s_time
        WHEN 6 THEN '{NOW}' ELSE ms_time END AS t FROM log""",
    "epoch_time": LOG + "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ms_time ELSE s_time END AS t FROM log",
    "lenient_numbers": LOG + """SELECT event_id, round(latency, 6) AS number, CAST(floor(latency) AS BIGINT) AS whole,
        round(CASE WHEN event_id % 2 = 0 THEN latency * 1000 ELSE latency END, 6) AS duration, true AS not_a_number FROM log""",
    "record_labels": LOG + """SELECT idx, status_class, label AS endpoint_label, endpoint AS endpoint_key, lower(label) AS search_key,
        CASE WHEN log_type = 'HTTP' THEN CAST(status AS VARCHAR) WHEN is_error THEN 'ERROR' ELSE 'SUCCESS' END AS display_status,
        severity FROM labelled""",
    "bucket_labels": LOG + """SELECT idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, strftime(ts, '%Y-%m-%d %H:%M') AS minutes,
        strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M') AS ten_minutes, strftime(ts, '%Y-%m-%d %H:00') AS hours FROM log""",
    "token_algebra": LOG + """SELECT idx, CAST(CASE WHEN same THEN 1.0 ELSE 0.5 END AS DOUBLE) AS similarity,
        method || ' ' || CASE WHEN same THEN raw_path ELSE '<*>' END AS merged, '<*>' AS ip_prefix, '2|' || method AS group_key
        FROM (SELECT *, raw_path = '/api/view/' || (idx % 150) AS same FROM log)""",
    "saturation": LOG + """SELECT event_id, round(least(100, 0.5 * least(100, ln(user_id + 2) * ((latency * 2.5 + ln(user_id + 2)) / 1000) / 8 * 100)
        + 0.3 * least(100, body_bytes / 1000 * 5)
        + 0.2 * least(100, greatest(0, (CASE WHEN latency > 0 THEN (latency * 2.5 + ln(user_id + 2)) / latency ELSE 1 END - 1) / 3 * 100))), 6) AS saturation FROM log""",
    "scalar_payload": r"SELECT event_id, 'p,t' AS keys, regexp_extract(props, '(\d+)', 1) AS p, 'v' AS t FROM events",
    "log_events": LOG + VIEW,
    "save_and_load": LOG + VIEW,
    "filter_time_slice": LOG + f"SELECT idx FROM log WHERE ts >= {NEWEST} - INTERVAL 24 HOURS",
    "saved_time_slice": LOG + f"SELECT idx FROM log WHERE ts >= {NEWEST} - INTERVAL 24 HOURS",
    "filter_text": LOG + "SELECT idx FROM labelled WHERE contains(lower(label), '[db] get') OR contains(lower(full_request), '[db] get')",
    "filter_log_types": LOG + "SELECT idx FROM log WHERE log_type IN ('DATABASE', 'APP')",
    "filter_methods": LOG + "SELECT idx FROM log WHERE method IN ('PUT', 'POST')",
    "filter_status_classes": LOG + "SELECT idx FROM labelled WHERE status_class IN ('5xx', 'Error')",
    "filter_latency": LOG + "SELECT idx FROM log WHERE latency BETWEEN 20 AND 80",
    "filter_combined": LOG + f"""SELECT idx FROM labelled WHERE ts >= {NEWEST} - INTERVAL 24 HOURS AND method = 'GET' AND log_type = 'HTTP'
        AND status_class IN ('2xx', '5xx') AND latency <= 100 AND contains(lower(label), 'api/view')""",
    "search_regex": LOG + r"SELECT idx FROM log WHERE severity = 'CRITICAL' AND regexp_matches(full_request, 'view/1\d$', 'i')",
    "search_substring": LOG + "SELECT idx FROM log WHERE contains(lower('(' || full_request), '(get')",
    "available_methods": LOG + "SELECT DISTINCT method FROM log",
    "kpis": LOG + KPIS,
    "stats_on_append": LOG + KPIS,
    "latency_percentiles": LOG + "SELECT " + ", ".join(f"round(quantile_disc(latency, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM log",
    "status_distribution": LOG + "SELECT status_class AS name, count(*) AS value FROM labelled GROUP BY 1",
    "method_distribution": LOG + "SELECT method AS name, count(*) AS value FROM log GROUP BY 1",
    "top_endpoints": LOG + ENDPOINTS.format(extra="", k=10),
    "top_endpoints_chart": LOG + ENDPOINTS.format(extra=", CASE WHEN length(label) > 30 THEN '...' || right(label, 30) ELSE label END AS short_path", k=5),
    "requests_over_time": LOG + """, w AS (SELECT epoch_ms(max(ts)) - epoch_ms(min(ts)) AS span FROM log)
        SELECT CASE WHEN span <= 120000 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN span <= 7200000 THEN strftime(ts, '%Y-%m-%d %H:%M')
          WHEN span <= 172800000 THEN strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%d %H:00') END AS time,
          count(*) AS count, count(*) FILTER (is_error) AS error_count, round(avg(latency), 6) AS avg_latency FROM log, w GROUP BY 1""",
    "golden_signals": LOG + """, g AS (SELECT quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95,
          count(*) / ((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000) AS traffic, 100.0 * count(*) FILTER (is_error) / count(*) AS errors FROM log)
        SELECT round(p95, 6) AS latency, round(traffic, 6) AS traffic, round(errors, 6) AS errors,
          round(least(100, 0.5 * least(100, traffic * p95 / 1000 / 8 * 100) + 0.3 * least(100, errors * 5)
            + 0.2 * least(100, greatest(0, (p95 / p50 - 1) / 3 * 100))), 6) AS saturation FROM g""",
    "latency_histogram": LOG + """, p AS (SELECT quantile_disc(latency, 0.95) * 1.5 AS reach FROM log),
        b AS (SELECT CAST(floor(latency / (reach / 20)) AS BIGINT) AS bin FROM log, p WHERE latency <= reach)
        SELECT CAST(round(i * reach / 20, 0) AS BIGINT) || '-' || CAST(round((i + 1) * reach / 20, 0) AS BIGINT) || 'ms' AS range,
          (SELECT count(*) FROM b WHERE b.bin = i) AS count, round(i * (reach / 20), 6) AS min FROM range(20) t(i), p""",
    "traffic_heatmap": LOG + f"SELECT hour, count, round(error_rate, 6) AS error_rate FROM ({HOURS})",
    "heatmap_intensity": LOG + f""", h AS ({HOURS}), m AS (SELECT greatest(max(count), 1) AS top FROM h)
        SELECT hour, count, round(count / top, 6) AS intensity, error_rate > 0.05 AS has_errors,
          round(greatest(0.2, count / top), 6) AS opacity, round(greatest(5, count / top * 100), 6) AS height FROM h, m""",
    "endpoint_baselines": LOG + BASELINES + "SELECT endpoint, n, round(median, 6) AS median, round(mad, 6) AS mad FROM base",
    "tight_medians": """SELECT event_type, count(*) AS n, (median(1 + value * 1e-12::DOUBLE) - 1) * 1e12::DOUBLE AS median
        FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "anomaly_scores": LOG + BASELINES + "SELECT idx, round(score, 6) AS anomaly_score FROM scored",
    "detect_anomalies": LOG + BASELINES + """SELECT idx, path, status, round(latency, 6) AS latency, round(score, 6) AS anomaly_score
        FROM flagged ORDER BY latency DESC, idx LIMIT 50""",
    "score_stream": LOG + BASELINES + "SELECT idx, status, round(score, 6) AS anomaly_score FROM flagged",
    "template_groups": LOG + "SELECT '2|' || method AS key, count(*) AS n FROM log GROUP BY 1",
    "cluster_logs": LOG + CLUSTERS + f"""SELECT {FNV_TEMPLATE} AS id, template, sample, count, error_count, avg_latency, severity
        FROM c ORDER BY count DESC, seen LIMIT 20""",
    "assign_templates": LOG + CLUSTERS + f"SELECT {FNV_TEMPLATE} AS cluster_id, count AS n FROM c",
    "view_digest": LOG + BASELINES + CLUSTERS + f""", e AS ({ENDPOINTS.format(extra=", min(idx) AS seen", k=5)})
        SELECT count(*) AS total_requests, printf('%.2f', round(100.0 * count(*) FILTER (is_error) / count(*), 2)) AS error_rate,
          printf('%.2f', round(avg(latency), 2)) AS avg_latency, printf('%.2f', round(quantile_disc(latency, 0.95), 2)) AS p95_latency,
          least(50, (SELECT count(*) FROM flagged)) AS anomalies,
          (SELECT string_agg(path || ' (' || printf('%.1f', round(error_rate, 1)) || '% errors)', ', ' ORDER BY count DESC, seen) FROM e) AS top_endpoints,
          (SELECT string_agg(template, chr(10) ORDER BY count DESC, seen) FROM (SELECT * FROM c ORDER BY count DESC, seen LIMIT 3)) AS patterns,
          'Time: ALL, Query: "None", Methods: GET, Status: All, Latency: 0ms - ∞ms' AS filters FROM log""",
    **{f"parse_{kind}": LOG + f"SELECT {record(**columns)} FROM log" for kind, columns in PARSED.items()},
    "parse_generic": f"""SELECT doc_id AS idx, 'MSG' AS method, 'raw_log' AS path, substring(replace(text, chr(10), ' '), 1, 100) AS full_request,
        'UNKNOWN' AS log_type, '{NOW}' AS time FROM documents""",
    "parse_mixed": mixed(),
    "parse_many_sources": many_sources(),
    "detect_format": "SELECT source, format, CAST(score AS DOUBLE) AS score FROM (VALUES "
    + ", ".join(f"('{k}.log', '{k}', 1.0)" for k in (*TEXT_KINDS, "json"))
    + ", ('csv.log', 'csv', 0.8), ('w3c.log', 'csv', 1.0), ('mixed.log', 'clf', 0.12)) t(source, format, score)",
    "read_lines": LOG + """SELECT event_id % 2 AS part, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS idx,
        full_request || ' ' || event_id AS line FROM log WHERE event_id % 10 >= 2""",
    "read_gzip_lines": LINE_REPORT,
    "export_csv": LOG + """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "Timestamp", severity AS "Severity", method AS "Method", path AS "Path",
        status AS "Status", round(latency, 6) AS latency, full_request AS "Message", user_agent AS "UserAgent", remote_ip AS "RemoteIP" FROM log""",
    "append": LOG + """, m AS (SELECT max(idx) + 1 AS start FROM log WHERE log_type = 'HTTP')
        SELECT log_type, count(*) AS n, min(idx) + CASE WHEN log_type = 'HTTP' THEN 0 ELSE any_value(start) END AS lo,
          max(idx) + CASE WHEN log_type = 'HTTP' THEN 0 ELSE any_value(start) END AS hi FROM log, m GROUP BY log_type""",
    "conversation_templates": "SELECT key, cluster, template, count, avg_latency FROM ("
    + templates("SELECT conv_id * 10000 + turn AS idx, text AS full_request, length(text) AS latency, false AS is_error, 'INFO' AS severity FROM conversations")
    + ")",
    "mixed_templates": templates(mixed_messages()),
    "append_ids": LOG + ", m AS (SELECT max(idx) + 1 AS start FROM log WHERE log_type = 'HTTP') SELECT idx + start AS idx, "
    + fnv("(idx + start) || ':' || full_request") + " AS id FROM log, m WHERE log_type <> 'HTTP'",
    "clear_events": "SELECT count(*) AS n, false AS loaded FROM events WHERE false",
    "get_field": LOG + """SELECT event_id, CAST(k AS BIGINT) AS nested, CASE WHEN event_id % 2 = 0 THEN CAST(1 AS BIGINT) END AS hidden FROM r""",
    "json_documents": LOG + "SELECT idx, 'GET' AS method, path, status FROM log WHERE event_id % 8 IN (0, 4)",
    "register_parser": LOG + "SELECT idx, 'HASH' AS method, raw_path AS path, status, is_error FROM log",
    "parse_stream_mixed": mixed_stream(),
    "stream_line_numbers": LOG + ", n AS (SELECT event_id % 4 AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS idx, "
    "full_request || ' ' || event_id AS raw_line FROM log WHERE event_id % 40 >= 4) SELECT part, idx, raw_line, "
    + fnv("idx || ':' || raw_line") + " AS id FROM n",
    "stream_csv": streamed_csv(),
    "filter_negative_latency": LOG + "SELECT idx FROM log WHERE method = 'GET' AND (idx % 2 = 0 OR latency = 0)",
    "search_accents": LOG + "SELECT idx FROM log WHERE idx % 3 = 0 AND method = 'GET'",
    "aggregate_stats": LOG + f"SELECT * FROM ({KPIS}) k, (SELECT "
    + ", ".join(f"round(quantile_disc(latency, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM log) q",
    "retain_last": LOG + "SELECT idx FROM log ORDER BY idx DESC LIMIT 1000",
    "parse_stream": LOG + "SELECT s_time AS time, method, path, status, round(latency, 6) AS latency, remote_ip, is_error FROM log",
    "windowed_signals": LOG + """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') || '.000' AS start, count(*) AS count,
        count(*) FILTER (is_error) AS error_count, round(avg(latency), 6) AS avg_latency,
        round(quantile_disc(latency, 0.95), 6) AS p95_latency FROM log GROUP BY 1""",
}

# The same statistics of all rows, whatever the epochs.
ORACLES |= {
    f"{name}_on_append": ORACLES[batch]
    for name, batch in (("baselines", "endpoint_baselines"), ("anomalies", "detect_anomalies"), ("requests_over_time", "requests_over_time"))
}
