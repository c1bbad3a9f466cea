"""Files that keep arriving, parsed with the line numbers, ids and headers of a batch read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank
from ..operators.parse import parse_profiled, source_profile
from ..parsers.base import ParseContext
from ..parsers.csv_lines import PREAMBLE_LINES
from ..plans.lookup import lookup_join
from ..session import materialize
from ..sources.lines import with_line_index

# What a source's earlier chunks leave behind, one row per source.
CHUNK_STATE = (
    "source string, total_lines bigint, records bigint, pinned string, cascade array<string>, fields_line string, "
    "first_line string, first_idx bigint, kept_header bigint, preamble array<bigint>, late_comments bigint"
)
# Every so many epochs all sources' rows are written again, so that fewer folders are ever read.
FOLD = 50


def parse_arrivals(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    ctx: ParseContext = ParseContext(),
    chunk: str | None = None,
    options: dict[str, str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Parse every file that arrives below `path` into `table`, one folder per epoch.

    A file comes whole, in one epoch, so what a batch read knows of it is known
    here too: (source, idx, id) are those of `parse_logs(read_lines(path))`, in
    any format, csv included. Its blocks are counted in one job and its lines
    are never shuffled.

    `chunk` is a pattern of what follows a source's name in the paths of its
    chunks, such as `\\.\\d+$`. Chunks of one source continue each other: by
    name within an epoch, by modification time across epochs (those of equal
    time in no certain order), and each ends with a whole line. Then one row per source is carried from epoch to epoch, with
    its line count, format and header:

    - The format is settled by the lines that the source's first epoch brings.
    - A csv source's header is its first line, or `#Fields:` in any epoch so
      far. One that comes after the first line has served as header renames
      the columns of its own and later epochs; records before it stay as they are.
    - Without any header line the first line is taken for one, as in a batch.

    An epoch that is run again reads only the state of those before it and
    replaces its own folder, so nothing counts twice. State lies in
    `<checkpoint>-sources`. Without `chunk` there is none.
    """
    raw = spark.readStream.options(**(options or {})).option("lineSep", "\n").text(path)
    file = F.col("_metadata.file_path")
    lines = raw.select(
        (file if chunk is None else F.regexp_replace(file, chunk, "")).alias("source"),
        F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    ).filter(~is_blank("line"))
    state = None if chunk is None else f"{checkpoint}-sources"

    def on_batch(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        # Files are cut alike in all jobs of the epoch, also if executors come or go.
        cores = session.conf.get("spark.sql.leafNodeDefaultParallelism", None) or session.sparkContext.defaultParallelism
        if session.conf.get("spark.sql.files.minPartitionNum", None) is None:
            session.conf.set("spark.sql.files.minPartitionNum", cores)
        numbered = with_line_index(batch)
        if state is None:
            profile = materialize(source_profile(numbered), "profile")
        else:
            known = _known(session, state, epoch)
            profile = materialize(_continued(source_profile(numbered), known), "profile")
            _save_state(profile, known, state, epoch)
            starts = profile.select("source", "start", "n_lines")
            moved = lookup_join(numbered, starts, ["source"], weight="n_lines")
            numbered = moved.select("source", (F.col("idx") + F.col("start")).alias("idx"), "line")
        parse_profiled(numbered, profile, ctx).write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return (
        lines.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def _known(spark: SparkSession, state: str, epoch: int) -> DataFrame:
    """The latest row of each source, of the epochs before this one."""
    if epoch == 0:
        return spark.createDataFrame([], CHUNK_STATE)
    since = max(epoch // FOLD * FOLD - 1, 0)
    rows = spark.read.schema(CHUNK_STATE + ", epoch bigint").parquet(state).filter(F.col("epoch").between(since, epoch - 1))
    names = [c for c in rows.columns if c not in ("source", "epoch")]
    latest = rows.groupBy("source").agg(F.max_by(F.struct(*names), "epoch").alias("row"))
    return latest.select("source", "row.*")


def _continued(here: DataFrame, known: DataFrame) -> DataFrame:
    """Profiles of this epoch, numbered on from what is known of their sources."""
    h, k = here.alias("h"), known.alias("k")
    seen = F.col("k.total_lines").isNotNull()
    start = F.coalesce("k.total_lines", F.lit(0))
    comments = F.transform("h.preamble", lambda i: i + start)
    early = F.filter(comments, lambda i: i < PREAMBLE_LINES)
    none = F.array().cast("array<bigint>")
    first_idx = F.coalesce("k.first_idx", F.col("h.first_idx") + start)
    fields_line = F.coalesce("k.fields_line", "h.fields_line")
    # The first line that served as header before a #Fields line came.
    kept = F.coalesce("k.kept_header", F.when(F.col("k.fields_line").isNull(), F.col("k.first_idx")))
    header_here = F.col("k.first_idx").isNull() & fields_line.isNull() & F.col("h.first_idx").isNotNull()
    earlier = F.coalesce("k.records", F.lit(0))

    def settled(name: str) -> Column:
        return F.when(seen, F.col(f"k.{name}")).otherwise(F.col(f"h.{name}")).alias(name)

    return h.join(k, F.col("h.source") == F.col("k.source"), "left").select(
        F.col("h.source").alias("source"),
        start.alias("start"),
        F.col("h.n_lines").alias("n_lines"),
        (start + F.col("h.n_lines")).alias("total_lines"),
        settled("pinned"),
        settled("cascade"),
        fields_line.alias("fields_line"),
        F.coalesce("k.first_line", "h.first_line").alias("first_line"),
        first_idx.alias("first_idx"),
        F.concat(F.coalesce("k.preamble", none), early).alias("preamble"),
        (F.coalesce("k.late_comments", F.lit(0)) + F.col("h.late_comments") + F.size(comments) - F.size(early)).alias("late_comments"),
        kept.alias("kept_header"),
        earlier.alias("earlier_records"),
        (earlier + F.col("h.n_lines") - F.col("h.comments") - header_here.cast("bigint")).alias("records"),
    )


def _save_state(profile: DataFrame, known: DataFrame, state: str, epoch: int) -> None:
    names = known.columns
    rows = profile.select(*names)
    if epoch % FOLD == FOLD - 1:
        rows = rows.unionByName(known.join(profile.select("source"), "source", "left_anti"))
    rows.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
