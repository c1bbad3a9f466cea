"""Lines out of zip archives.

The driver and the listing step only see names; every member is streamed by
the task that owns it, in batches, so no archive is held in memory.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import ASCII_SPACES, WIDE_SPACES

BATCH_LINES = 20_000


def _opener():
    """Opens a path of any file system as a seekable stream."""

    def open_stream(path: str):
        from pyarrow import fs

        uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        system, inner = fs.FileSystem.from_uri(uri)
        return system.open_input_file(inner)

    return open_stream


def _list_members():
    open_stream = _opener()

    def run(batches):
        import zipfile

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with open_stream(path) as stream, zipfile.ZipFile(stream) as archive:
                    names = [i.filename for i in archive.infolist()]
                rows += [
                    (path, place, name)
                    for place, name in enumerate(names)
                    if not name.endswith("/") and "__MACOSX" not in name
                ]
            yield pd.DataFrame(rows, columns=["source", "member", "name"])

    return run


def _read_members():
    open_stream = _opener()
    size, spaces = BATCH_LINES, ASCII_SPACES + WIDE_SPACES

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            for source, member, name in zip(pdf["source"], pdf["member"], pdf["name"]):
                with open_stream(source) as stream, zipfile.ZipFile(stream) as archive, archive.open(name) as body:
                    text = io.TextIOWrapper(body, encoding="utf-8", errors="replace", newline="\n")
                    filled = (t for t in text if t.strip(spaces))
                    batch = []
                    for place, line in enumerate(filled):
                        batch.append((source, int(member), place, line.rstrip("\n").removesuffix("\r")))
                        if len(batch) >= size:
                            yield pd.DataFrame(batch, columns=["source", "member", "place", "line"])
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=["source", "member", "place", "line"])

    return run


def read_zip_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, idx, line) of all files in zip archives, members one after another.

    One task per member, not per archive. Folders and `__MACOSX` entries are skipped.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")
    members = archives.mapInPandas(_list_members(), "source string, member int, name string")
    spread = members.repartition("source", "member")
    lines = spread.mapInPandas(_read_members(), "source string, member int, place bigint, line string")
    counts = lines.groupBy("source", "member").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "member", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    # One row per member; the planner picks the join by its size.
    return lines.join(offsets, ["source", "member"]).select(
        "source", (F.col("offset") + F.col("place")).alias("idx"), "line"
    )
