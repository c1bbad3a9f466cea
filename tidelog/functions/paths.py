"""Request line → method and normalised path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# Path segments that are replaced by placeholders.
UUID_SEGMENT = r"/([0-9a-fA-F-]{32,}|[0-9a-fA-F-]{36})(/|$)"
ID_SEGMENT = r"/(\d+)(/|$)"


def _unknown(request: Column) -> Column:
    return request.isNull() | request.isin("", "-")


def request_method(request: Column | str) -> Column:
    r = col(request)
    first = F.split_part(r, F.lit(" "), F.lit(1))
    return (
        F.when(_unknown(r), "UNKNOWN")
        .when(first.rlike(r"^[A-Z]+$"), first)
        .otherwise("MSG")
    )


def strip_query(path: Column | str) -> Column:
    return F.split_part(col(path), F.lit("?"), F.lit(1))


def mask_ids(path: Column | str) -> Column:
    """`/123/` → `/:id/`. A match uses up its closing slash, so `/1/2/3` → `/:id/2/:id`."""
    return F.regexp_replace(col(path), ID_SEGMENT, "/:id$2")


def mask_uuids(path: Column | str) -> Column:
    return F.regexp_replace(col(path), UUID_SEGMENT, "/:uuid$2")


def request_path(request: Column | str) -> Column:
    r = col(request)
    raw = F.when(r.contains(" "), F.split_part(r, F.lit(" "), F.lit(2))).otherwise(r)
    return F.when(_unknown(r), "UNKNOWN").otherwise(mask_ids(mask_uuids(strip_query(raw))))


def normalize_path(request: Column | str) -> Column:
    """struct(method, path) of a request line such as `GET /users/1?x=2 HTTP/1.1`."""
    return F.struct(request_method(request).alias("method"), request_path(request).alias("path"))


def clf_path(path: Column | str) -> Column:
    """Access-log rule: query cut, numeric ids masked, uuids kept."""
    return mask_ids(strip_query(path))


def short_path(path: Column | str, width: int = 30) -> Column:
    p = col(path)
    return F.when(F.length(p) > width, F.concat(F.lit("..."), F.right(p, F.lit(width)))).otherwise(p)
