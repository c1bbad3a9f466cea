"""Delimited files with a header line, and W3C extended logs with `#Fields:`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import determine_severity
from ..functions.paths import request_method, request_path
from ..functions.text import lenient_float, lenient_int, space_aware, trim_space
from ..plans.lookup import lookup_join
from ..session import materialize
from .base import ParseContext, ParserSpec, text_map, to_events, with_defaults

# A column is the first header that contains one of these.
HEADER_KEYS = {
    "status": ("status", "sc-status"),
    "method": ("method", "cs-method"),
    "path": ("uri", "path", "cs-uri-stem"),
    "time": ("time", "timestamp", "date"),
    "took": ("time-taken", "latency", "duration"),
}
FIELDS_TAG = "#Fields:"

# Stands in for a separator inside quotes while a line is split.
QUOTED_SEPARATOR = "\ufffe"

# Lines per block when positions are counted without one window per source.
POSITION_BLOCK = 65_536
# Comment lines up to here are remembered one by one; W3C preambles are short.
PREAMBLE_LINES = 64


def split_cells(line: Column, separator: Column) -> Column:
    """Cells of a delimited line.

    Splitting at `"` makes every odd piece quoted text, so a separator in an
    odd piece belongs to its cell. An empty piece between two quoted ones is
    a doubled quote, which stands for one quote character.
    """
    masked = F.array_join(
        F.transform(
            F.split(line, '"', -1),
            lambda piece, i: F.when(i % 2 == 1, F.replace(piece, separator, F.lit(QUOTED_SEPARATOR))).otherwise(piece),
        ),
        '"',
    )

    def unquote(cell: Column) -> Column:
        pieces = F.split(cell, '"', -1)
        inner = F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.when(
                    (i % 2 == 0) & (piece == "") & (i > 0) & (i < F.size(pieces) - 1), '"'
                ).otherwise(piece),
            ),
            "",
        )
        return F.replace(inner, F.lit(QUOTED_SEPARATOR), separator)

    def cells(text: Column) -> Column:
        return F.when(separator == "\t", F.split(text, "\t", -1)).otherwise(F.split(text, ",", -1))

    raw = F.when(line.contains('"'), F.transform(cells(masked), unquote)).otherwise(cells(line))
    return F.transform(raw, lambda cell: F.regexp_replace(trim_space(cell), "^'|'$", ""))


def header_aggregates() -> list[Column]:
    """Per-source aggregates a delimited parse needs; all are bounded in size."""
    line, idx = F.col("line"), F.col("idx")
    comment = line.startswith("#")
    return [
        F.min_by(F.when(line.startswith(FIELDS_TAG), line), F.when(line.startswith(FIELDS_TAG), idx)).alias("fields_line"),
        F.min_by(F.when(~comment, line), F.when(~comment, idx)).alias("first_line"),
        F.sort_array(F.collect_list(F.when(comment & (idx < PREAMBLE_LINES), idx))).alias("preamble"),
        F.count_if(comment & (idx >= PREAMBLE_LINES)).alias("late_comments"),
        F.min(F.when(~comment, idx)).alias("first_idx"),
        F.count("*").alias("n_lines"),
        F.count_if(comment).alias("comments"),
        # What earlier chunks of the source settled; nothing when the source is read whole.
        F.lit(None).cast("bigint").alias("kept_header"),
        F.lit(0).cast("bigint").alias("earlier_records"),
    ]


def _position(headers: Column, keys: tuple[str, ...]) -> Column:
    """1-based place of the first header containing a key, 0 if there is none."""
    hit = F.transform(
        headers,
        lambda h: F.array_contains(F.transform(F.array(*map(F.lit, keys)), lambda k: F.contains(F.lower(h), k)), True),
    )
    return F.coalesce(F.array_position(hit, True), F.lit(0)).cast("int")


def resolve_headers(profile: DataFrame) -> DataFrame:
    """Separator, header cells and column places of each source."""
    tagged = F.col("fields_line").isNotNull()
    out = profile.withColumn("separator", F.when(F.col("first_line").contains("\t"), "\t").otherwise(","))
    named = trim_space(F.substring(F.col("fields_line"), len(FIELDS_TAG) + 1, 2**30))
    named = space_aware(named, r"\s+", lambda text, p: F.split(text, p))
    out = out.withColumn(
        "headers", F.when(tagged, named).otherwise(split_cells(F.col("first_line"), F.col("separator")))
    )
    headers = F.col("headers")
    return out.select(
        "source",
        "separator",
        F.struct(
            F.size(headers).alias("width"),
            *[_position(headers, keys).alias(name) for name, keys in HEADER_KEYS.items()],
            F.array_position(headers, "date").cast("int").alias("date"),
            F.array_position(headers, "time").cast("int").alias("clock"),
            F.array_contains(headers, "time-taken").alias("in_seconds"),
            # Index of the line that serves as header and is no record itself.
            F.coalesce("kept_header", F.when(~tagged, F.col("first_idx"))).alias("header_idx"),
        ).alias("layout"),
        "preamble",
        "late_comments",
        "earlier_records",
        "n_lines",
    )


def _ordinals(lines: DataFrame) -> DataFrame:
    """`ordinal` = place of each record among its source's records.

    Sources whose comments all sit in the preamble need no shuffle: the place
    is the line index less the few comments and the header before it. The
    others are counted per block of lines, then per source over the blocks.
    """
    idx = F.col("idx")
    header = F.when(F.col("layout.header_idx").isNotNull(), 1).otherwise(0)
    before = F.size(F.filter(F.col("preamble"), lambda p: p < idx))
    simple = lines.filter(F.col("late_comments") == 0).withColumn("ordinal", idx - before - header)

    late = lines.filter(F.col("late_comments") > 0).withColumn("block", F.floor(idx / POSITION_BLOCK))
    per_block = late.groupBy("source", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("source", "block").orderBy("idx"))
    counted = (
        late.withColumn("within", within)
        .join(offsets, ["source", "block"])
        .withColumn("ordinal", F.col("earlier_records") + F.col("offset") + F.col("within") - 1)
        .drop("block", "within", "offset")
    )
    return simple.unionByName(counted)


def parse_with_layout(lines: DataFrame, ctx: ParseContext, any_late: bool = True) -> DataFrame:
    """Parse lines that already carry their source's layout columns."""
    line, layout = F.col("line"), F.col("layout")
    records = lines.filter(~line.startswith("#") & ~F.coalesce(F.col("idx") == layout["header_idx"], F.lit(False)))
    if any_late:
        records = _ordinals(records)
    else:
        header = F.when(layout["header_idx"].isNotNull(), 1).otherwise(0)
        before = F.size(F.filter(F.col("preamble"), lambda p: p < F.col("idx")))
        records = records.withColumn("ordinal", F.col("idx") - before - header)
    records = records.withColumn("cells", split_cells(line, F.col("separator")))
    records = records.filter(F.size("cells") >= layout["width"] * 0.5)

    def cell(place: Column) -> Column:
        return F.nullif(F.get(F.col("cells"), F.coalesce(place, F.lit(0)) - 1), F.lit(""))

    method = F.coalesce(cell(layout["method"]), F.lit("MSG"))
    raw_path = F.coalesce(cell(layout["path"]), F.lit("-"))
    request = F.concat_ws(" ", method, raw_path)
    status = F.coalesce(lenient_int(cell(layout["status"])), F.lit(0))
    took = lenient_float(cell(layout["took"]))
    raw_time, date = cell(layout["time"]), cell(layout["date"])
    split_date = (layout["date"] > 0) & (layout["date"] != layout["time"])
    when = F.when(split_date, F.concat_ws(" ", F.coalesce(date, F.lit("")), raw_time)).otherwise(raw_time)
    if not ctx.strict_w3c:
        # `date` is found before `time`; read both rather than the day alone.
        both = (layout["date"] > 0) & (layout["date"] == layout["time"]) & (layout["clock"] > 0)
        when = F.when(both, F.concat_ws(" ", date, cell(layout["clock"]))).otherwise(when)
    fields = {
        "time": F.coalesce(raw_time, F.lit("")),
        "timestamp": ctx.time(F.when(raw_time.isNotNull(), when)),
        "method": request_method(request),
        "path": request_path(request),
        "full_request": request,
        "status": status,
        "latency": F.coalesce(F.when(layout["in_seconds"], took * 1000).otherwise(took), F.lit(0.0)),
        "is_error": status >= 400,
        "severity": determine_severity(status, raw_path),
        "log_type": F.lit("HTTP"),
        "metadata": text_map(source="CSV/TSV"),
    }
    return to_events(records, with_defaults(fields, line), ctx, F.col("ordinal"))


def parse_csv(lines: DataFrame, ctx: ParseContext = ParseContext()) -> DataFrame:
    """Delimited lines → events. The header row of each source names the columns."""
    profile = materialize(lines.groupBy("source").agg(*header_aggregates()), "headers")
    any_late = not profile.filter(F.col("late_comments") > 0).isEmpty()
    layout = resolve_headers(profile)
    return parse_with_layout(lookup_join(lines, layout, ["source"], weight="n_lines").drop("n_lines"), ctx, any_late)


def _score(line: Column, idx: Column) -> Column:
    first = F.min_by(line, idx)
    return (
        F.when(trim_space(first).startswith("{"), 0.0)
        .when(F.max(line.startswith(FIELDS_TAG)), 1.0)
        .when(first.contains("\t"), 0.9)
        .when(first.contains(",") & F.lower(first).contains("status"), 0.8)
        .otherwise(0.0)
    )


CSV = ParserSpec(
    id="csv",
    matches=lambda line: F.lit(False),
    fields=lambda line, groups: {},
    score=_score,
    exclusive=True,
    parse_all=parse_csv,
)
