"""Labels and classes derived from one parsed record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def determine_severity(status: Column | str, message: Column | str) -> Column:
    s, text = col(status), F.lower(col(message))
    return (
        F.when(s >= 500, "CRITICAL")
        .when(s >= 400, "ERROR")
        .when(text.contains("error") | text.contains("fail"), "ERROR")
        .when(text.contains("warn"), "WARN")
        .otherwise("INFO")
    )


def status_class(log_type="log_type", status="status", is_error="is_error") -> Column:
    """`2xx`-style class for HTTP records, Error / Success for all others."""
    http = F.concat(F.floor(col(status) / 100).cast("string"), F.lit("xx"))
    return F.when(col(log_type) == "HTTP", http).otherwise(
        F.when(col(is_error), "Error").otherwise("Success")
    )


def endpoint_key(method="method", path="path") -> Column:
    return F.concat_ws(" ", col(method), col(path))


def endpoint_label(log_type="log_type", method="method", path="path") -> Column:
    key = endpoint_key(method, path)
    return (
        F.when(col(log_type) == "DATABASE", F.concat(F.lit("[DB] "), key))
        .when(col(log_type) == "SYSTEM", F.concat(F.lit("[SYS] "), col(path)))
        .when(col(log_type) == "APP", F.concat(F.lit("[APP] "), key))
        .otherwise(key)
    )


def search_key(log_type="log_type", method="method", path="path") -> Column:
    return F.lower(endpoint_label(log_type, method, path))


def message_preview(message="full_request", width: int = 200) -> Column:
    m = col(message)
    return F.when(F.length(m) > width, F.concat(F.substring(m, 1, width), F.lit("..."))).otherwise(m)


def display_status(log_type="log_type", status="status", is_error="is_error") -> Column:
    return F.when(col(log_type) == "HTTP", col(status).cast("string")).otherwise(
        F.when(col(is_error), "ERROR").otherwise("SUCCESS")
    )


def scalar_metadata(metadata="metadata") -> Column:
    """Entries of a text map that hold a value."""
    return F.map_filter(col(metadata), lambda _, v: v.isNotNull())


def scalar_payload(payload: Column | str) -> Column:
    """Top-level entries of a VARIANT object that are neither null nor nested, as text."""
    entries = F.try_variant_get(col(payload), "$", "map<string,variant>")
    kind = F.schema_of_variant
    flat = F.map_filter(
        entries,
        lambda _, v: ~(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY") | F.is_variant_null(v)),
    )
    return F.transform_values(flat, lambda _, v: F.try_variant_get(v, "$", "string"))
