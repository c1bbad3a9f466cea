"""What a log format is, and the table of known formats.

A format is a set of Column builders, so that parsing is one projection that
Catalyst can prune: a column nobody selects is never computed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import log_id
from ..functions.labels import determine_severity
from ..functions.text import matches, space_aware
from ..functions.times import now_or, parse_date
from ..schema import LOG_EVENTS

# Separates captured groups; a Unicode noncharacter, so not part of log text.
GROUP_MARK = "\uffff"


@dataclass(frozen=True)
class ParseContext:
    """Choices that a line itself does not settle."""

    now: Column | None = None
    syslog_year: int = 2001
    fix_ms: bool = False
    epoch_text: bool = False
    strict_w3c: bool = False
    # Added to every line's index: where a chunk of a longer source begins.
    start_index: int = 0

    def time(self, text: Column) -> Column:
        return parse_date(text, self.now, self.syslog_year, self.epoch_text)

    def current(self) -> Column:
        return now_or(self.now)


Fields = dict[str, Column]
_TYPES = {**{f.name: f.dataType for f in LOG_EVENTS.fields}, "time": "string"}


@dataclass(frozen=True)
class ParserSpec:
    """One log format.

    matches   line → boolean: is this line in the format?
    fields    (line, groups) → record columns, with the date text under `time`;
              absent ones take defaults
    captures  line → array of strings, computed once and handed to `fields`
    score     aggregate over the sampled `line` column, 0..1; default is the
              share of sampled lines that match
    exclusive drop lines that do not match instead of trying other formats
    parse_all (lines, context) → events for formats that need the whole source
    """

    id: str
    matches: Callable[[Column], Column]
    fields: Callable[[Column, Column], Fields] = field(repr=False)
    captures: Callable[[Column], Column] | None = None
    score: Callable[[Column, Column], Column] | None = None
    exclusive: bool = False
    parse_all: Callable[[DataFrame, ParseContext], DataFrame] | None = None


def regex_captures(pattern: str) -> Callable[[Column], Column]:
    """All groups of a matching line in one pass, as an array; unset groups are ''."""
    groups = re.compile(pattern).groups
    whole = pattern.removesuffix("$") + r"(?s:.*)$"
    marked = GROUP_MARK.join(f"${n}" for n in range(1, groups + 1))

    def split_groups(line: Column, p: str) -> Column:
        return F.split(F.regexp_replace(line, p, marked), GROUP_MARK, -1)

    return lambda line: space_aware(line, whole, split_groups)


def regex_format(spec_id: str, pattern: str, fields) -> ParserSpec:
    return ParserSpec(
        id=spec_id,
        matches=lambda line: matches(line, pattern),
        captures=regex_captures(pattern),
        fields=fields,
    )


def group(groups: Column, n: int) -> Column:
    """n-th captured group, counted from 1."""
    return F.get(groups, F.lit(n - 1))


def first_match(text: Column, pattern: str, n: int = 1) -> Column:
    """Group of the first match inside a message, null if there is none."""
    found = space_aware(text, pattern, lambda t, p: F.regexp_extract(t, p, n))
    return F.nullif(found, F.lit(""))


def text_map(**entries: Column | str) -> Column:
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), F.lit(value) if isinstance(value, str) else value]
    return F.create_map(*pairs).cast("map<string,string>")


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def with_defaults(fields: Fields, line: Column) -> Fields:
    """Complete a record: anything the format does not carry gets its neutral value.

    Formats that say nothing about errors are judged by status in `to_events`.
    """
    defaults = {
        "time": F.lit(""),
        "method": F.lit("MSG"),
        "path": F.lit("-"),
        "full_request": line,
        "status": F.lit(0),
        "latency": F.lit(0.0),
        "upstream_latency": F.lit(0.0),
        "user_agent": F.lit("-"),
        "remote_ip": F.lit("-"),
        "referer": F.lit("-"),
        "is_error": F.lit(None).cast("boolean"),
        "severity": F.lit(None).cast("string"),
        "log_type": F.lit("UNKNOWN"),
        "body_bytes": F.lit(0),
        "metadata": empty_map(),
    }
    return {**defaults, **fields}


def to_events(
    df: DataFrame,
    fields: Fields,
    ctx: ParseContext,
    id_index: Column | None = None,
    *extra: Column,
    message: str | None = None,
) -> DataFrame:
    """Project (source, idx, line) plus record columns to the `log_events` schema.

    Works in two steps, so that a value several columns derive from (status,
    date text) is computed once, whatever the format was. Where a format
    gives no severity it follows from the status and, if named, `message`.
    """
    carried = [c for c in ("source", "idx", "line") if c in df.columns]
    index = F.col("idx") if id_index is None else id_index
    step = df.select(
        *carried,
        (index + ctx.start_index).cast("bigint").alias("id_index"),
        *[c.cast(_TYPES[name]).alias(f"r_{name}") for name, c in fields.items()],
        *extra,
    )

    def r(name: str) -> Column:
        return F.col(f"r_{name}")

    text = F.lit("") if message is None else r(message)
    severity = F.coalesce(r("severity"), determine_severity(r("status"), text))
    base = {
        "id": log_id(F.col("line"), F.col("id_index")),
        "source": F.col("source"),
        "idx": F.col("idx") + ctx.start_index,
        "raw_line": F.col("line"),
        "timestamp": r("timestamp") if "timestamp" in fields else ctx.time(r("time")),
        "original_timestamp": r("time"),
        "is_error": F.coalesce(r("is_error"), (r("status") >= 400) | severity.isin("ERROR", "CRITICAL")),
        "severity": severity,
    }
    columns = [base.get(f.name, F.col(f"r_{f.name}")).cast(f.dataType).alias(f.name) for f in LOG_EVENTS.fields]
    return step.select(*columns, *[c for c in step.columns if c == "payload"])


def parse_with(spec: ParserSpec, lines: DataFrame, ctx: ParseContext) -> DataFrame:
    """Parse lines known to be in one format; lines that are not are dropped."""
    if spec.parse_all is not None:
        return spec.parse_all(lines, ctx)
    line = F.col("line")
    hits = lines.filter(spec.matches(line))
    if spec.captures is not None:
        hits = hits.withColumn("groups", spec.captures(line))
        groups = F.col("groups")
    else:
        groups = F.array().cast("array<string>")
    return to_events(hits, with_defaults(spec.fields(line, groups), line), ctx)
