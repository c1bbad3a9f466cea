"""Near copies among vectors: an exact range join under the angle between them, cell by cell.

Equal vectors of a label are one class with a count. Pivots, spread over a bounded sample, partition the classes:
each has its home in the cell of its nearest pivot. Two vectors within r of each other have, by the triangle
inequality, distances to any pivot that differ by r at most. So whatever lies within r of a vector at home in cell j
has a distance to pivot j of at most 2r above that to its own nearest pivot, and is replicated to cell j. A cell then
holds all partners of those at home in it, and cells are joined independently; a cell with more rows than a tile
takes is cut into blocks, and each pair of blocks is a task of its own.

Inside a tile cosines are matrix products. Partners are counted and united there, so a group of many similar vectors
leaves a tile as one row per member and never as pairs. The result does not depend on pivots, blocks or their number:
those follow from what the sample says of the work, as does how many copies replication makes. Where all vectors lie
far apart from their pivots, as vectors without any structure do, no pivot rules out anything and a label is compared
in full.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.session import materialize

from .common import small
from .components import components

LEAST = 0.98
#: Classes from which pivots are chosen, and the numbers of pivots that are weighed.
SAMPLE = 4096
PIVOTS = (4, 8, 16, 32, 64, 128)
#: Bytes of vectors in a block, and how many comparisons cost as much as shipping a row.
TILE_BYTES = 4 << 20
SHIPPING = 500
#: Room for rounding: in an angle, and in a cosine before it is computed term by term.
SLACK = 1e-6
CLOSE = 1e-12


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, grp, unit): vectors of length 1 as bytes, null where a row takes no part."""

    def run(batches):
        for batch in batches:
            vec, label = batch.column("embedding"), batch.column("label").to_pylist()
            values, ends = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            keys, groups, units = [], [], []
            for i, (null, said) in enumerate(zip(vec.is_null().to_pylist(), label)):
                v = values[ends[i] : ends[i + 1]]
                top = 0.0 if null or said is None or not len(v) else np.abs(v).max()
                if not 0 < top < np.inf:  # also false for NaN
                    keys.append(None), groups.append(None), units.append(None)
                    continue
                v = v + 0.0  # no negative zeros: equal vectors have equal bytes
                unit = v / top
                unit = unit / np.sqrt((unit * unit).sum())
                group = f"{len(v)}|{said}"
                keys.append(hashlib.sha256(group.encode() + b"\0" + v.tobytes()).digest())
                groups.append(group), units.append(unit.tobytes())
            columns = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(groups, pa.string()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "grp", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return rows.mapInArrow(run, "vec_id long, key binary, grp string, unit binary")


def _matrix(units: list[bytes], width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros, longer ones cut: enough for products with pivots."""
    out = np.zeros((len(units), width))
    for row, u in zip(out, units):
        v = np.frombuffer(u)[:width]
        row[: len(v)] = v
    return out


def _angles(units: list[bytes], pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_matrix(units, pivots.shape[1]) @ pivots.T, -1, 1))


def choose_pivots(groups: list[str], units: list[bytes], reach: float, total: int, numbers=PIVOTS) -> np.ndarray:
    """As many far-apart vectors of the sample as make the least work for `total` classes."""
    width = max(len(u) for u in units) // 8
    points = _matrix(units, width)
    picked, angle = [0], np.arccos(np.clip(points @ points[0], -1, 1))
    while len(picked) < min(max(numbers), len(points)):
        picked.append(int(angle.argmax()))
        angle = np.minimum(angle, np.arccos(np.clip(points @ points[picked[-1]], -1, 1)))
    codes = np.unique(groups, return_inverse=True)[1]
    angles = np.arccos(np.clip(points @ points[picked].T, -1, 1))
    times = total / len(points)

    def work(n: int) -> float:
        home = angles[:, :n].argmin(axis=1)
        row, cell = np.nonzero(angles[:, :n] <= angles[:, :n].min(axis=1, keepdims=True) + 2 * reach)
        held = np.bincount(codes[row] * n + cell, minlength=(codes.max() + 1) * n)
        housed = np.bincount(codes * n + home, minlength=len(held))
        return float((held * housed).sum() * times**2 + SHIPPING * len(row) * times)

    best = min((n for n in numbers if n <= len(picked)), key=work, default=len(picked))
    return points[picked[:best]]


def _deal(pivots: np.ndarray, reach: float, sizes_only: bool = False):
    """Each class to its home cell and to the cells where it may have partners."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column("unit").to_pylist()
            angles = _angles(units, pivots)
            row, cell = np.nonzero(angles <= angles.min(axis=1, keepdims=True) + 2 * reach + SLACK)
            if sizes_only:
                groups, code = np.unique(np.array(batch.column("grp").to_pylist(), object), return_inverse=True)
                size = np.array([len(u) for u in units], np.int64)
                held, rows = np.unique(code[row] * len(pivots) + cell, return_inverse=True)
                grp = pa.array([groups[h // len(pivots)] for h in held], pa.string())
                yield pa.RecordBatch.from_arrays([grp, pa.array(held % len(pivots), pa.int32()), pa.array(np.bincount(rows, weights=size[row]).astype(np.int64))], ["grp", "cell", "bytes"])
                continue
            at = pa.array(row)
            columns = [batch.column("node").take(at), batch.column("n").take(at), batch.column("grp").take(at), batch.column("unit").take(at)]
            columns += [pa.array(cell, pa.int32()), pa.array(angles.argmin(axis=1)[row] == cell)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "grp", "unit", "cell", "home"])

    return run


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`parent` (every member's smallest known one) after linking each a with its b."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
    return parent


def join_tile(node: np.ndarray, n: np.ndarray, home: np.ndarray, units: np.ndarray, left: np.ndarray, right: np.ndarray, least: float):
    """(links, root): for each row, the vectors linked with it if it is at home here, and its group's first row."""
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    step = max(1, (4 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        cosines = units[rows] @ units[right].T
        i, j = np.nonzero(cosines >= least - CLOSE)
        value = cosines[i, j]
        i, j = rows[i], right[j]
        for k in np.flatnonzero(np.abs(value - least) <= CLOSE):
            value[k] = (units[i[k]] * units[j[k]]).sum()
        linked = (value >= least) & (node[i] != node[j]) & (home[i] | home[j])
        i, j = i[linked], j[linked]
        links += np.bincount(i, weights=n[j], minlength=len(node)).astype(np.int64)
        if left is not right:
            links += np.bincount(j, weights=n[i], minlength=len(node)).astype(np.int64)
        parent = _unite(parent, i, j)
    links[~home] = 0
    return links, parent


def _tiles(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        home, block = table.column("home").to_numpy(), table.column("block").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(node), -1)
        low, high = key[2].as_py(), key[3].as_py()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        links, parent = join_tile(node, n, home, units, left, right, least)
        root = node[parent]
        told = (links > 0) | (root != node)
        return pa.table({"node": node[told], "links": links[told], "root": root[told]})

    return run


def near_copies(vectors: DataFrame, least: float = LEAST, numbers: tuple[int, ...] = PIVOTS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors` (vec_id, embedding, label).

    Vectors of equal label and length are linked if their cosine reaches `least`. One that is null, empty, zero or holds
    null or non-finite components is linked with nothing, nor is one without a label. Rows that are repeated are
    vectors of their own. component_id is the smallest id of those reachable; null ids count as no id, so it is null
    where there is no other. A row is kept if its id is its component_id, two nulls included.
    """
    reach = math.acos(least)
    rows = materialize(unit_vectors(vectors), "unit-vectors")
    valid = rows.filter(F.col("key").isNotNull())
    classes = valid.groupBy("key", "grp", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("grp", "unit").toArrow()
    alone = rows.filter(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if sample.num_rows:
        pivots = choose_pivots(sample.column("grp").to_pylist(), [bytes(u) for u in sample.column("unit").to_pylist()], reach, classes.count(), numbers)
        told = materialize(_join_cells(classes, pivots, reach, least, tile_bytes), "vector-links")
        grouped = components(told.filter("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = told.groupBy("node").agg(F.sum("links").alias("links"))
        placed = classes.select("key", "node", "n", "low").join(grouped, "node", "left").join(links, "node", "left")
        placed = placed.withColumn("root", F.coalesce("root", "node"))
        lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
        n_links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
        of_class = placed.join(lowest, "root").select("key", n_links.alias("n_links"), "component_id")
        alone = alone.unionByName(valid.select("vec_id", "key").join(of_class, "key").drop("key"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _join_cells(classes: DataFrame, pivots: np.ndarray, reach: float, least: float, tile_bytes: int) -> DataFrame:
    """(node, links, root) from every tile of every cell."""
    wanted = classes.select("node", "n", "grp", "unit")
    sizes = wanted.mapInArrow(_deal(pivots, reach, sizes_only=True), "grp string, cell int, bytes long").groupBy("grp", "cell").agg(F.sum("bytes").alias("bytes"))
    sizes = materialize(sizes.select("grp", "cell", F.ceil(F.col("bytes") / tile_bytes).cast("int").alias("blocks")), "cell-sizes")
    dealt = wanted.mapInArrow(_deal(pivots, reach), "node long, n long, grp string, unit binary, cell int, home boolean")
    dealt = dealt.join(small(sizes), ["grp", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "n", "grp", "unit", "cell", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return dealt.groupBy("grp", "cell", "low", "high").applyInArrow(_tiles(least), "node long, links long, root long")


SQL = f"""
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}
),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings JOIN m ON m.v = vec_id LEFT JOIN n ON n.a = vec_id
"""
