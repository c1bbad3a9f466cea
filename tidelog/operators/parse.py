"""Lines of any mix of formats → one `log_events` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..parsers import GENERIC, known_formats, parse_with
from ..parsers.base import ParseContext, ParserSpec, to_events, with_defaults
from ..parsers.csv_lines import CSV, header_aggregates, parse_with_layout, resolve_headers
from ..parsers.json_lines import JSON, parse_json
from ..plans.lookup import lookup_join
from ..session import materialize
from .detect import PIN_SCORE, ranked, score_columns


def source_profile(lines: DataFrame) -> DataFrame:
    """One row per source: format ranking, settled format, header lines, weight.

    A single aggregation with map-side partial results; a source holding a
    third of the data still sends one row per partition.
    """
    specs = known_formats()
    profile = lines.groupBy("source").agg(*score_columns(specs), *header_aggregates())
    kept = [c for c in profile.columns if not c.startswith("score_")]
    return (
        profile.withColumn("ranked", ranked(specs))
        .withColumn("pinned", F.when(F.col("ranked")[0]["key"] <= -PIN_SCORE, F.col("ranked")[0]["id"]))
        .withColumn("cascade", F.transform("ranked", lambda r: r["id"]))
        .select(*kept, "pinned", "cascade")
    )


def _pick(by: Column, branches: dict[str, Column], otherwise: Column | None = None) -> Column:
    chain = reduce(lambda acc, kv: acc.when(by == kv[0], kv[1]), branches.items(), F)
    return chain if otherwise is None else chain.otherwise(otherwise)


def accepted_formats(line: Column, specs: list[ParserSpec]) -> Column:
    """One entry per format, null where it refuses the line. All patterns are
    anchored, so a refusal is cheap."""
    return F.array(*[F.when(s.matches(line), F.lit(s.id)) for s in specs])


def choose_format(accepted: Column, specs: list[ParserSpec]) -> Column:
    """Format of one line: the pinned one if it accepts the line, else the
    best-ranked non-exclusive one that does, else generic; null drops the line."""
    pinned = F.col("pinned")
    exclusive = F.coalesce(pinned.isin([s.id for s in specs if s.exclusive]), F.lit(False))
    open_formats = F.array(*[F.lit(s.id) for s in specs if not s.exclusive])
    best = F.get(F.array_intersect(F.array_intersect(F.col("cascade"), open_formats), accepted), F.lit(0))
    return (
        F.when(F.array_contains(accepted, pinned), pinned)
        .when(exclusive, None)
        .otherwise(F.coalesce(best, F.lit(GENERIC.id)))
    )


def parse_cascade(lines: DataFrame, ctx: ParseContext, specs: list[ParserSpec]) -> DataFrame:
    """Parse lines that carry `pinned` and `cascade` of their source, in one projection."""
    line = F.col("line")
    per_line = [s for s in specs if s.parse_all is None]
    tested = lines.withColumn("accepted", accepted_formats(line, per_line))
    typed = tested.withColumn("format", choose_format(F.col("accepted"), per_line))
    if any(s.exclusive for s in per_line):
        # Only then can a line be dropped; a filter would test every pattern twice.
        typed = typed.filter(F.col("format").isNotNull())
    no_groups = F.array().cast("array<string>")
    captures = {s.id: s.captures(line) for s in per_line if s.captures is not None}
    typed = typed.withColumn("groups", _pick(F.col("format"), captures, no_groups))

    records = {s.id: s.fields(line, F.col("groups")) for s in per_line}
    fields = {}
    for name, generic in with_defaults(GENERIC.fields(line, no_groups), line).items():
        # A format without this column has the neutral value, as generic does.
        branches = {i: r[name] for i, r in records.items() if name in r}
        fields[name] = _pick(F.col("format"), branches, generic) if branches else generic
    return to_events(typed, fields, ctx)


def parse_logs(lines: DataFrame, ctx: ParseContext = ParseContext()) -> DataFrame:
    """Detect each source's format and parse every line.

    A source whose best score reaches 0.6 is settled on that format; formats
    that read whole sources (json, csv) then take all of it. Lines of other
    sources go to the first format that accepts them, else become generic.
    """
    return parse_profiled(lines, materialize(source_profile(lines), "profile"), ctx)


def parse_profiled(lines: DataFrame, profile: DataFrame, ctx: ParseContext = ParseContext()) -> DataFrame:
    """Parse lines whose sources' profiles, one materialised row each, are known."""
    specs = known_formats()
    settled = {r["pinned"]: r["late"] for r in profile.groupBy("pinned").agg(F.sum("late_comments").alias("late")).collect()}
    whole = [s for s in specs if s.parse_all is not None and s.id in settled]

    parts = []
    for spec in whole:
        rows = profile.filter(F.col("pinned") == spec.id)
        if spec is CSV:
            layout = resolve_headers(rows)
            mine = lookup_join(lines, layout, ["source"], weight="n_lines")
            parts.append(parse_with_layout(mine, ctx, settled[spec.id] > 0))
        else:
            mine = lookup_join(lines, rows.select("source", "n_lines"), ["source"], weight="n_lines")
            mine = mine.select(*lines.columns)
            parts.append(parse_json(mine, ctx) if spec is JSON else spec.parse_all(mine, ctx))
    if set(settled) - {s.id for s in whole}:
        rows = profile.filter(~F.coalesce(F.col("pinned").isin([s.id for s in whole]), F.lit(False)))
        mine = lookup_join(lines, rows.select("source", "n_lines", "pinned", "cascade"), ["source"], weight="n_lines")
        parts.append(parse_cascade(mine, ctx, specs))
    if not parts:
        return parse_with(GENERIC, lines, ctx)
    return reduce(DataFrame.unionByName, parts)
