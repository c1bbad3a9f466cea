"""The same operators on lines that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank
from ..operators.anomalies import is_anomaly, score
from ..operators.parse import parse_cascade
from ..parsers import known_formats, parse_with
from ..parsers.base import ParseContext
from ..plans.bundle import Stats, aggregate_stats
from ..plans.states import MergedStats, States
from ..schema import LOG_EVENTS


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Unbounded (source, idx, line) of files arriving in a folder.

    Counting the lines of a file needs the whole file, so `idx` is the start of
    the line's block plus its number in the block: it rises along the file and
    never repeats, as every line takes at least one byte.
    """
    raw = spark.readStream.options(**options).option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    return lines.filter(~is_blank("line")).mapInPandas(_number_lines(), "source string, idx bigint, line string")


def _number_lines():
    def run(batches):
        last, count = None, 0
        for pdf in batches:
            key = pdf["source"].astype(str) + "\n" + pdf["block"].astype(str)
            begins = (key != key.shift()).to_numpy()
            if len(key) and key.iloc[0] == last:
                begins[0] = False
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(begins, at, -1))
            within = np.where(start < 0, at + count, at - start)
            if len(key):
                last, count = key.iloc[-1], int(within[-1]) + 1
            yield pdf.assign(idx=pdf["block"].to_numpy() + within)[["source", "idx", "line"]]

    return run


def parse_stream(lines: DataFrame, format_id: str, ctx: ParseContext = ParseContext()) -> DataFrame:
    """Stateless parse, in the format found at the start (detection needs a sample).

    A line that this format refuses goes to the first other one that takes it,
    in the order of the known formats, and becomes generic if none does. Formats
    that read whole sources (json) drop what they refuse, as in batches; csv
    needs its header line, for which `parse_arrivals` keeps state.
    """
    if format_id == "csv":
        raise ValueError("csv needs its header line; use parse_arrivals")
    specs = known_formats()
    spec = next(s for s in specs if s.id == format_id)
    if spec.parse_all is not None:
        return parse_with(spec, lines, ctx)
    order = [format_id, *[s.id for s in specs if s.id != format_id]]
    typed = lines.withColumn("pinned", F.lit(format_id)).withColumn("cascade", F.array(*map(F.lit, order)))
    return parse_cascade(typed, ctx, specs)


def stats_on_append(
    events: DataFrame,
    table: str,
    checkpoint: str,
    report: Callable[[Stats, int], None],
    retain: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Append each micro-batch to a table and report on all of it, or on the
    `retain` records that arrived last.

    A report on all of it reads mergeable states, written beside the table, and
    not the events, but for templates (see `plans/states.py`); the last records
    are read from the table. A batch that is run again after a failure replaces
    its own folder and states, so no record counts twice.
    """
    spark = events.sparkSession

    def on_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        if retain is None:
            states = States(spark, table)
            states.add(epoch)
            return report(MergedStats(states, epoch), epoch)
        everything = spark.read.option("basePath", table).parquet(f"{table}/epoch=*")
        latest = everything.orderBy(F.desc("epoch"), F.desc("idx"), F.desc("source")).limit(retain)
        report(aggregate_stats(latest.select(*LOG_EVENTS.fieldNames())), epoch)

    return (
        events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def windowed_signals(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests, errors, mean and p95 latency per tumbling window.

    Works on streams and on tables. p95 comes from a sketch, which keeps the
    state per window bounded; records later than `delay` are dropped in a stream.
    """
    errors = F.count_if("is_error")
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width).alias("window"))
        .agg(
            F.count("*").alias("count"),
            errors.alias("error_count"),
            F.avg("latency").alias("avg_latency"),
            F.percentile_approx("latency", 0.95, 10_000).alias("p95_latency"),
        )
        .select(F.col("window.start").alias("start"), "count", "error_count", "avg_latency", "p95_latency")
    )


def score_stream(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """Anomalous records of a stream, judged by saved endpoint baselines."""
    return score(events, baselines).filter(is_anomaly())
