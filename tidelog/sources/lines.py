"""Text files → (source, idx, line), with blank lines left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ids import log_id
from ..functions.text import is_blank
from ..plans.lookup import fits_broadcast
from ..session import materialize


# What decides how files are cut into partitions, besides the files themselves.
CUTTING = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, block, line) of `.log .txt .json .csv .tsv` files, plain or `.gz`.

    Plain files are split by block; a gzip file is one block. Lines end at
    `\\n`, with an optional `\\r` before it. The files are cut as the settings say
    now, also if those change, or the cluster grows, before a later job reads
    them: a file scan asks the session that made it, so it is made in one of its own.
    """
    pinned = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if pinned.conf.isModifiable(name):
            pinned.conf.set(name, value)
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    pinned.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None) or cores)
    for name in CUTTING:
        pinned.conf.set(name, spark.conf.get(name))
    view = f"text_{uuid.uuid4().hex}"
    raw = pinned.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # Only the scan belongs to that session; everything on top of it follows the caller's.
    lines.createGlobalTempView(view)
    shared = spark.conf.get("spark.sql.globalTempDatabase", "global_temp")
    found = spark.read.table(f"{shared}.{view}").filter(~is_blank("line"))
    pinned.catalog.dropGlobalTempView(view)
    return found


def with_line_index(lines: DataFrame) -> DataFrame:
    """Add `idx`, the place of each line among its source's lines.

    Lines of one block lie next to each other in one partition, so their place
    in the block is a difference of row ids: no sort and no shuffle of lines.
    The lines are read twice and never written: one job counts those of each
    block, and the index is one row per block. That holds as long as the files
    are cut into the same blocks and those into the same partitions. It is
    checked for every line: one outside its block's row ids, as when a file
    was changed or lines that can be cut otherwise were given, stops the job.
    """
    block = F.xxhash64("source", "block")
    numbered = lines.select("source", "line", "block", block.alias("block_id"), F.monotonically_increasing_id().alias("row"))
    blocks = numbered.groupBy("source", "block", "block_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = materialize(blocks.select("block_id", "first", "n", start.alias("start")), "blocks")
    total = starts.agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("ids")).first()
    if total["n"] != total["ids"]:
        raise RuntimeError("two blocks share a hash; read the files in two parts")
    # About thirty bytes per block of 128 MB: a million blocks, 128 TB of text, are
    # broadcast. Beyond that lines meet their block's row in a shuffle; no block
    # is large, so that is even.
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    within = F.col("row") - F.col("first")
    known = (within >= 0) & (within < F.col("n"))
    moved = F.raise_error(F.concat(F.lit("lines are no longer cut as they were counted: "), "source"))
    return numbered.join(starts, "block_id", "left").select(
        "source", F.when(known, F.col("start") + within).otherwise(moved.cast("long")).alias("idx"), "line"
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return with_line_index(read_text(spark, path))


def append(events: DataFrame, chunk: DataFrame) -> DataFrame:
    """Add a later chunk behind what is there: its `idx` continues the sequence, and its ids follow from that."""
    start = F.coalesce(events.agg(F.max("idx")).scalar() + 1, F.lit(0))
    moved = chunk.withColumn("idx", F.col("idx") + start)
    if "id" in chunk.columns:
        moved = moved.withColumn("id", log_id("raw_line", "idx"))
    return events.unionByName(moved)


def retain_last(events: DataFrame, n: int = 10_000) -> DataFrame:
    """The n records that arrived last."""
    return events.orderBy(F.desc("idx"), F.desc("source")).limit(n)
