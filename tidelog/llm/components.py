"""Connected components of a table of links, without gathering the links anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.session import materialize


def _united(batches):
    """Union-find over one partition: its links as (member, smallest member) pairs, at most one per node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead; links run from large to small."""
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    low = links.unionByName(larger).groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return larger.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the smallest of them; links run from large to small."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.withColumnRenamed("low", "b")).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b: long); root is the component's smallest node.

    Links are first united within each partition, then by alternating stars until nothing moves; each round is
    written to the shared folder, so a lost executor costs no more than a round.
    """
    now = materialize(links.filter("a <> b").mapInArrow(_united, "a long, b long"), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        now = materialize(_small_star(_large_star(now)), "links")
    inner = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return inner.unionByName(inner.select(F.col("root").alias("node"), "root").distinct())
