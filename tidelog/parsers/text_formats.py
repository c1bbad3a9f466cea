"""Text formats: one regular expression per line shape, fields from its groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.paths import clf_path, request_path
from ..functions.text import lenient_float, or_dash
from . import patterns as P
from .base import Fields, ParserSpec, first_match, group, regex_format, text_map


def _digits(text: Column, to: str = "int") -> Column:
    return text.try_cast(to)


def _clf(line: Column, g: Column) -> Fields:
    raw_time, method, path = group(g, 3), group(g, 4), group(g, 5)
    # A trailing number with a point is the request time: seconds below 100.
    tail = F.substring_index(line, " ", -1)
    took = F.when(tail.contains("."), lenient_float(tail))
    return {
        "time": raw_time,
        "method": method,
        "path": clf_path(path),
        "full_request": F.concat_ws(" ", method, path),
        "status": _digits(group(g, 7)),
        "latency": F.coalesce(F.when(took < 100, took * 1000).otherwise(took), F.lit(0.0)),
        "user_agent": or_dash(group(g, 12)),
        "remote_ip": group(g, 1),
        "referer": or_dash(group(g, 10)),
        "log_type": F.lit("HTTP"),
        "body_bytes": _digits(group(g, 8), "bigint"),
    }


def _alb(line: Column, g: Column) -> Fields:
    raw_time, request, elb_status = group(g, 1), group(g, 7), group(g, 5)
    target = lenient_float(group(g, 3))
    waited = F.when(target == -1, 0.0).otherwise(target)
    status = _digits(group(g, 6))
    return {
        "time": raw_time,
        "method": F.split_part(request, F.lit(" "), F.lit(1)),
        "path": request_path(request),
        "full_request": request,
        "status": status,
        "latency": (lenient_float(group(g, 2)) + waited + lenient_float(group(g, 4))) * 1000,
        "upstream_latency": target * 1000,
        "user_agent": group(g, 8),
        "is_error": (status >= 400) | (_digits(elb_status) >= 400),
        "log_type": F.lit("HTTP"),
        "metadata": text_map(source="AWS_ALB", elbStatus=elb_status),
    }


def _envoy(line: Column, g: Column) -> Fields:
    raw_time, method, path = group(g, 1), group(g, 2), group(g, 3)
    request = F.concat_ws(" ", method, path)
    return {
        "time": raw_time,
        "method": method,
        "path": request_path(request),
        "full_request": request,
        "status": _digits(group(g, 4)),
        "latency": _digits(group(g, 7), "double"),
        "upstream_latency": _digits(group(g, 8), "double"),
        "user_agent": or_dash(group(g, 9)),
        "log_type": F.lit("HTTP"),
        "body_bytes": _digits(group(g, 5), "bigint"),
        "metadata": text_map(source="Envoy", requestId=group(g, 10)),
    }


def _java(line: Column, g: Column) -> Fields:
    raw_time, level, logger, message = group(g, 1), group(g, 2), group(g, 5), group(g, 6)
    verb = first_match(message, P.HTTP_IN_MESSAGE, 1)
    target = first_match(message, P.HTTP_IN_MESSAGE, 2)
    method = F.coalesce(verb, F.lit("LOG"))
    last_part = F.nullif(F.substring_index(logger, ".", -1), F.lit(""))
    return {
        "time": raw_time,
        "method": method,
        "path": request_path(F.concat_ws(" ", method, F.coalesce(target, last_part, F.lit("App")))),
        "full_request": message,
        "is_error": level.isin("ERROR", "FATAL"),
        "severity": F.when(level.isin("ERROR", "FATAL"), "ERROR").when(level == "WARN", "WARN").otherwise("INFO"),
        "log_type": F.when(verb.isNotNull(), "HTTP").otherwise("APP"),
        "metadata": text_map(source="Java", thread=group(g, 4), pid=group(g, 3), logger=logger),
    }


def _mongo(line: Column, g: Column) -> Fields:
    raw_time, letter, component, message = group(g, 1), group(g, 2), group(g, 3), group(g, 5)
    severity = F.when(letter == "W", "WARN").when(letter == "E", "ERROR").when(letter == "F", "CRITICAL").otherwise("INFO")
    return {
        "time": raw_time,
        "method": F.coalesce(F.upper(first_match(message, P.MONGO_COMMAND)), F.lit("MONGO")),
        "path": component,
        "full_request": message,
        "latency": F.coalesce(first_match(message, P.MONGO_DURATION).try_cast("double"), F.lit(0.0)),
        "is_error": letter.isin("E", "F"),
        "severity": severity,
        "log_type": F.lit("DATABASE"),
        "metadata": text_map(source="MongoDB", context=group(g, 4), component=component),
    }


def _redis(line: Column, g: Column) -> Fields:
    raw_time = group(g, 2)
    return {
        "time": raw_time,
        "method": F.lit("REDIS"),
        "path": F.lit("server"),
        "full_request": group(g, 4),
        "severity": F.when(group(g, 3) == "#", "WARN").otherwise("INFO"),
        "log_type": F.lit("DATABASE"),
        "metadata": text_map(source="Redis", role=group(g, 1)),
    }


def _syslog(line: Column, g: Column) -> Fields:
    raw_time, message = group(g, 2), group(g, 6)
    status = F.coalesce(first_match(message, P.SYSLOG_STATUS).try_cast("int"), F.lit(0))
    text = F.lower(message)
    failed = (status >= 400) | text.contains("error") | text.contains("fail")
    return {
        "time": raw_time,
        "method": F.lit("SYSLOG"),
        "path": group(g, 4),
        "full_request": message,
        "status": status,
        "remote_ip": group(g, 3),
        "is_error": failed,
        "severity": F.when(failed, "ERROR").otherwise("INFO"),
        "log_type": F.lit("SYSTEM"),
        "metadata": text_map(pid=F.nullif(group(g, 5), F.lit("")), pri=group(g, 1)),
    }


def _k8s(line: Column, g: Column) -> Fields:
    raw_time, stream, content = group(g, 1), group(g, 2), group(g, 3)
    status = F.coalesce(first_match(content, P.K8S_STATUS).try_cast("int"), F.lit(0))
    failed = (stream == "stderr") | content.contains(" E") | content.startswith("E")
    warned = content.contains(" W") | content.startswith("W")
    return {
        "time": raw_time,
        "method": F.lit("LOG"),
        "path": F.coalesce(first_match(content, P.K8S_COMPONENT), F.lit("k8s-pod")),
        "full_request": content,
        "status": status,
        "latency": F.coalesce(first_match(content, P.K8S_DURATION).try_cast("double"), F.lit(0.0)),
        "is_error": failed,
        "severity": F.when(failed, "ERROR").when(warned, "WARN").otherwise("INFO"),
        "log_type": F.when(status > 0, "HTTP").otherwise("APP"),
        "metadata": text_map(stream=stream),
    }


def _postgres(line: Column, g: Column) -> Fields:
    raw_time, pid, level, message = group(g, 1), group(g, 3), group(g, 5), group(g, 6)
    verb = F.upper(first_match(message, P.POSTGRES_STATEMENT, 1))
    table = first_match(message, P.POSTGRES_STATEMENT, 2)
    failed = level.isin("ERROR", "FATAL", "PANIC")
    return {
        "time": raw_time,
        "method": F.coalesce(verb, F.lit("SQL")),
        "path": F.coalesce(table, F.when(verb == "SELECT", "unknown_table"), F.lit("query")),
        "full_request": message,
        "latency": F.coalesce(lenient_float(first_match(message, P.POSTGRES_DURATION)), F.lit(0.0)),
        "user_agent": F.concat(F.lit("Postgres "), pid),
        "is_error": failed,
        "severity": F.when(failed, "ERROR").when(level == "WARNING", "WARN").otherwise("INFO"),
        "log_type": F.lit("DATABASE"),
        "metadata": text_map(pid=pid, user=group(g, 4), timezone=group(g, 2)),
    }


def generic_fields(line: Column, _groups: Column) -> Fields:
    """Last resort for a line no format accepts."""
    return {"path": F.lit("raw_log"), "full_request": F.substring(line, 1, 100)}


CLF = regex_format("clf", P.CLF, _clf)
ALB = regex_format("alb", P.ALB, _alb)
ENVOY = regex_format("envoy", P.ENVOY, _envoy)
JAVA = regex_format("java", P.JAVA, _java)
MONGO = regex_format("mongo", P.MONGO, _mongo)
REDIS = regex_format("redis", P.REDIS, _redis)
SYSLOG = regex_format("syslog", P.SYSLOG, _syslog)
K8S = regex_format("k8s", P.K8S, _k8s)
POSTGRES = regex_format("postgres", P.POSTGRES, _postgres)
GENERIC = ParserSpec(id="generic", matches=lambda line: F.lit(True), fields=generic_fields)

# Order decides ties between equal scores.
TEXT_FORMATS = (CLF, ALB, ENVOY, JAVA, MONGO, REDIS, SYSLOG, K8S, POSTGRES)
