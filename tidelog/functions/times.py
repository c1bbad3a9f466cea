"""Timestamps out of log text, and time-bucket labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# Text shapes the reference's date reader accepts, and the
# pattern that reads each of them. Anything else counts as unreadable.
ISO_SHAPE = r"^\d{4}(-\d{2}){0,2}$|^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
DATE_SHAPES = (
    (r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\S+ [+-]\d{4}$", "d/MMM/yyyy:HH:mm:ss xx"),
    (r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\S+$", "d/MMM/yyyy:HH:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}:\S+ [+-]\d{4}$", "yyyy/M/d:HH:mm:ss xx"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}(\.\d+)?$", "d MMM yyyy HH:mm:ss[.SSSSSSSSS]"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]+$", "d MMM yyyy HH:mm:ss z"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d", "yyyy/M/d H:m:s[.SSSSSSSSS]"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d", "M/d/yyyy H:m:s[.SSSSSSSSS]"),
)
WEEKDAY = r"^[A-Za-z]{3}, "
UNTIDY = r"^[A-Za-z]{3}, |[\t\n\x0B\f\r]|  "
YEARLESS_SHAPE = r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2}$"
EPOCH_SECONDS_BELOW = 10_000_000_000

MINUTE_MS = 60 * 1000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS


def now_or(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def to_millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


def iso_time(text: Column | str) -> Column:
    return to_millis(col(text).try_cast("timestamp"))


def shaped_time(text: Column | str, pattern: str) -> Column:
    return to_millis(F.try_to_timestamp(col(text), F.lit(pattern)))


def yearless_time(text: Column | str, year: int) -> Column:
    return shaped_time(F.concat(F.lit(f"{year} "), col(text)), "yyyy MMM d HH:mm:ss")


def epoch_time(number: Column | str) -> Column:
    """Seconds below ten billion, milliseconds from there on."""
    n = col(number).cast("double")
    return F.timestamp_millis(F.when(n < EPOCH_SECONDS_BELOW, n * 1000).otherwise(n).cast("bigint"))


def parse_date(
    text: Column | str,
    now: Column | None = None,
    syslog_year: int = 2001,
    epoch_text: bool = False,
) -> Column:
    """Any date text → TIMESTAMP in milliseconds; unreadable or missing → `now`.

    Zone-less text is read in the session zone. Dates without a year get
    `syslog_year`. Digits given as text are unreadable unless `epoch_text`.
    """
    raw = col(text)
    tidy = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), WEEKDAY, "")
    t = F.when(raw.rlike(UNTIDY), tidy).otherwise(raw)
    parsed = F.when(t.rlike(ISO_SHAPE), iso_time(t))
    for shape, pattern in DATE_SHAPES:
        parsed = parsed.when(t.rlike(shape), shaped_time(t, pattern))
    parsed = parsed.when(t.rlike(YEARLESS_SHAPE), yearless_time(t, syslog_year))
    if epoch_text:
        parsed = parsed.when(t.rlike(r"^\d{9,15}(\.\d+)?$"), epoch_time(t.try_cast("double")))
    return F.coalesce(parsed, now_or(now))


def span_ms(first: Column, last: Column) -> Column:
    return F.unix_millis(last) - F.unix_millis(first)


def bucket_label(ts: Column | str, span: Column) -> Column:
    """Label of the time bucket; its width follows the span of the whole view."""
    t = col(ts)
    ten_minutes = F.concat(
        F.date_format(t, "yyyy-MM-dd HH:"),
        F.lpad((F.floor(F.minute(t) / 10) * 10).cast("string"), 2, "0"),
    )
    return (
        F.when(span <= 2 * MINUTE_MS, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(span <= 2 * HOUR_MS, F.date_format(t, "yyyy-MM-dd HH:mm"))
        .when(span <= 2 * DAY_MS, ten_minutes)
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:00"))
    )


def coarser_label(label: Column | str, span: Column) -> Column:
    """A label of a shorter view as `bucket_label` gives it for a view of this span; widths are nested."""
    t = col(label)
    return (
        F.when(span <= 2 * MINUTE_MS, t)
        .when(span <= 2 * HOUR_MS, F.left(t, F.lit(16)))
        .when(span <= 2 * DAY_MS, F.concat(F.left(t, F.lit(15)), F.lit("0")))
        .otherwise(F.concat(F.left(t, F.lit(13)), F.lit(":00")))
    )
