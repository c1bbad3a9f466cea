"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.plans.lookup import fits_broadcast

#: What an Arrow batch may take. The default, 64 MB, comes with long texts and is held several times over per task.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its rows and bytes, counted on the data, are within the limit."""
    return F.broadcast(df) if fits_broadcast(df) else df


def repeated(df: DataFrame, copies: str) -> DataFrame:
    """Each row as many times as its column `copies` says, without that column."""
    rest = [c for c in df.columns if c != copies]
    return df.select(*rest, F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int"))).alias("_copy")).select(*rest)


def release() -> None:
    """Give back to the system what a task no longer needs: its worker lives on, beside those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `limit` bytes of text, so that a task's scratch memory doesn't follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
    release()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that operators on documents read, whatever else the table holds.

    Sets the session's limit of bytes per Arrow batch, unless the session has one of its own: a limit of rows alone
    lets a task's memory follow the length of the texts. No result depends on it.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """The rows of `docs` that no row of `gone` meets by `same`, a condition on doc_id, text and columns of `gone`.

    The other columns travel in a struct, so their names can't clash. `gone` is broadcast if its size allows it.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(small(gone), same, "left_anti").select("_row.*")
