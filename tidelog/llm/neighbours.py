"""Approximate nearest neighbours: balanced posting lists behind a graph of centroids.

A bounded sample is clustered into lists of about equal length, and lists that come out long are split. The
centroids and a neighbour graph over them are small and go to every worker. Every vector is written to the list of
its nearest centroid and, if it lies near a boundary, to those of other centroids about as near. A query finds its
nearest centroids through the graph, reads the nearest lists until they hold several times what it asks for, and
those about as far as the last of these, and ranks what it finds there by exact distance. A query that found too
little is searched again in more lists, in the end in all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.plans.lookup import lookup_join
from tidelog.session import materialize


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # centroids that a search starts from


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Centres of `lists` clusters; each round the fullest clusters are halved in place of the emptiest."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), lists, replace=False)].copy()
    for k in range(rounds):
        at = nearest(points, centres)
        size = np.bincount(at, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        if k < rounds - 3:
            order = np.argsort(size)
            long = order[::-1][: max(1, lists // 8)]
            for full, empty in zip(long[size[long] > 1.5 * len(points) / lists], order):
                if size[empty] * 3 > size[full]:
                    break
                one, other = points[draw.choice(np.flatnonzero(at == full), 2, replace=False)]
                centres[empty], centres[full] = (centres[full] + one) / 2, (centres[full] + other) / 2
    return centres


def build_index(points: np.ndarray, lists: int, degree: int = 16) -> Index:
    centres = balanced_centroids(points, lists) if lists > 1 else points.mean(0, keepdims=True)
    near = distances(centres, centres)
    np.fill_diagonal(near, -1)
    graph = np.argsort(near, axis=1, kind="stable")[:, 1 : degree + 1]
    # Far apart entries, each the centroid farthest from those before it, so that no region is out of reach.
    entries = [0]
    away = near[0].copy()
    while len(entries) < min(lists, max(8, int(lists**0.5))):
        entries.append(int(away.argmax()))
        away = np.minimum(away, near[entries[-1]])
    return Index(centres, graph, np.array(entries))


def search_graph(index: Index, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest centroids found for each point, nearest first, and their distances; -1 where fewer."""
    n, lists = len(points), len(index.centroids)
    if width >= lists:
        dist = distances(points, index.centroids)
        ids = np.argsort(dist, axis=1, kind="stable")
        return ids, np.take_along_axis(dist, ids, 1)
    seen = np.zeros((n, lists), bool)
    seen[:, index.entries] = True
    ids = np.tile(index.entries, (n, 1))
    dist = distances(points, index.centroids[index.entries])
    opened = np.zeros(ids.shape, bool)
    row = np.arange(n)[:, None]
    squares = (index.centroids**2).sum(1)
    own = (points**2).sum(1)
    while True:
        keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
        ids, dist, opened = ids[row, keep], dist[row, keep], opened[row, keep]
        waiting = np.where(opened | (ids < 0), np.inf, dist)
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :4]
        fresh = np.isfinite(waiting[row, pick])
        if not fresh.any() or not index.graph.shape[1]:
            return ids, dist
        opened[row, pick] = True
        near = index.graph[ids[row, pick]]
        near = np.where(fresh[:, :, None], near, -1).reshape(n, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[row, near] & (near >= 0)] = -1
        valid = near >= 0
        seen[np.broadcast_to(row, near.shape)[valid], near[valid]] = True
        gap = np.full(near.shape, np.inf)
        who, _ = np.nonzero(valid)
        there = near[valid]
        cross = np.einsum("ij,ij->i", points[who], index.centroids[there])
        gap[valid] = np.sqrt(np.maximum(own[who] - 2 * cross + squares[there], 0))
        ids, dist = np.concatenate([ids, near], 1), np.concatenate([dist, gap], 1)
        opened = np.concatenate([opened, ~valid], 1)


@dataclass(frozen=True)
class Reach:
    """Which of the nearest lists a query reads."""

    probes: int  # at most so many
    floor: int  # at least so many
    held: int  # and as many as hold so many vectors of the sample
    ratio: float  # further ones up to 1 + ratio times as far as the last of those
    sizes: np.ndarray  # vectors of the sample by list

    def lists_read(self, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """How many of the lists `ids`, nearest first at `dist`, each query reads; -1 stands for none."""
        ids, dist = ids[:, : self.probes], dist[:, : self.probes]
        enough = np.cumsum(self.sizes[ids], axis=1) >= self.held
        last = np.where(enough.any(1), enough.argmax(1), ids.shape[1] - 1)
        last = np.minimum(np.maximum(last, self.floor - 1), ids.shape[1] - 1)
        return ((ids >= 0) & (dist <= np.take_along_axis(dist, last[:, None], 1) * (1 + self.ratio))).sum(1)


def reach_needed(index: Index, points: np.ndarray, k: int, target: float, probes: int, floor: int, ratio: float, asked: int = 256) -> Reach:
    """Bounds, from `probes` and `floor` upwards, within which the lists read hold a share `target` of the `k` nearest
    points of each of some points.

    Judged on the sample alone, pruning included. Neighbours in all vectors lie nearer than those in a sample, and
    further lists hold copies of them, so this errs on the side of too many.
    """
    queries = points[:: max(1, len(points) // asked)]
    gaps = distances(queries, points)
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : k + 1]
    home = nearest(points, index.centroids)
    sizes = np.bincount(home, minlength=len(index.centroids))
    dist = distances(queries, index.centroids)
    ids = np.argsort(dist, axis=1, kind="stable")
    place = np.argsort(ids, axis=1, kind="stable")[np.arange(len(queries))[:, None], home[near]]
    ranks = np.sort(place.ravel())
    if len(ranks):
        probes = max(probes, int(ranks[min(len(ranks) - 1, int(target * len(ranks)))]) + 1)
    dist = np.take_along_axis(dist, ids, 1)
    while True:
        reach = Reach(probes, min(floor, probes), 4 * (k + 1), ratio, sizes)
        if floor >= probes or not len(ranks) or (place < reach.lists_read(ids, dist)[:, None]).mean() >= target:
            return reach
        floor *= 2


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(sound & F.exists("embedding", lambda x: x != 0))


def listed(df: DataFrame, index, dim: int, width: int, ratio: float, reach: Reach | None, extra: str) -> DataFrame:
    """`df` (key, embedding and what `extra` declares) once per list it belongs to, with `list`.

    These are the lists that a query reads within `reach`, or, without it, those that a vector is written to: of
    the `width` nearest the ones within `ratio`.
    """

    def place(batches):
        ix = index.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                points = matrix(part.column("embedding"), dim)
                ids, dist = search_graph(ix, points, width)
                if reach:
                    chosen = np.arange(ids.shape[1]) < reach.lists_read(ids, dist)[:, None]
                else:
                    chosen = (ids >= 0) & (dist <= dist[:, :1] * (1 + ratio))
                    # A further list must not lie nearer to one already chosen than to the vector.
                    for k in range(1, ids.shape[1]):
                        for m in range(k):
                            between = np.sqrt(((ix.centroids[ids[:, k]] - ix.centroids[ids[:, m]]) ** 2).sum(1))
                            chosen[:, k] &= ~(chosen[:, m] & (between < 0.6 * dist[:, k]))
                who, at = np.nonzero(chosen)
                out = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ids[who, at].astype(np.int32))], [*out.schema.names, "list"])

    return df.mapInArrow(place, f"{extra}, embedding array<double>, list int")


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    sample_rows: int = 20_000,
    list_length: int = 200,
    most_lists: int = 4096,
    replicas: int = 6,
    boundary: float = 0.15,
    probes: int = 16,
    recall: float = 0.95,
    prune: float = 0.6,
    fewest: int = 4,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row of `queries`, by Euclidean distance.

    Both tables: vec_id, embedding. A row is no candidate of a query with its id. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do null ids; of several dimensions the most frequent one
    (the smallest of equals) does. Equal vectors are one entry of the index with their k + 1 smallest ids, which
    is all that any result can show of them. Ties go to the smaller vec_id. Distances are exact, in double
    precision, on the original vectors.

    Centroids come from at most `sample_rows` vectors; every vector is indexed. A query reads up to `probes` lists,
    or as many as the sample needs for this `recall`, less those beyond `prune`: (1 + prune) times as far as the
    last of the `fewest` nearest, or of as many as hold 4 (k + 1) vectors of the sample if that is more; `fewest`
    rises until the sample keeps its `recall`. A query that still found fewer than `k` is searched again in eight
    times as many lists, until it has `k` or has read all, so fewer are returned only if there are fewer
    candidates. The index, at most `most_lists` centroids, is broadcast. Lists longer than a few thousand vectors are spread over several tasks.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = usable(vectors)
    dims = base.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    dim = dims["dim"]
    base = base.filter(F.size("embedding") == dim)
    # The k + 1 smallest ids of each vector; cut within each map task before rows are dealt out.
    number = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ranked = base.select("vec_id", "embedding").distinct().withColumn("_n", number).filter(F.col("_n") <= k + 1)
    entries = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries.select(F.col("ids")[0].alias("key"), "ids", "embedding"), "vectors")
    n, held_ids = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    lists = max(1, min(most_lists, n // list_length))
    take = min(sample_rows, (64 << 20) // (8 * dim))
    sample = entries.select("embedding").orderBy(F.xxhash64("key")).limit(take).toArrow()
    points = matrix(sample.column("embedding").combine_chunks(), dim)
    built = build_index(points, min(lists, max(1, len(points) // 4)))
    reach = reach_needed(built, points, k, recall, probes, fewest, prune)
    index = spark.sparkContext.broadcast(built)

    asked = usable(queries).filter(F.size("embedding") == dim).withColumn("key", F.xxhash64("embedding"))
    probing = asked.groupBy("key").agg(F.any_value("embedding").alias("embedding"))
    salts = 1 + int(n * replicas / lists) // 8192
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    posted = listed(entries.select("key", "ids", "embedding"), index, dim, replicas, boundary, None, "key long, ids array<long>").withColumn("salt", salt)

    def rank(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query": [], "vec_id": [], "score": []}
        if asking.num_rows and held.num_rows:
            points = matrix(held.column("embedding").combine_chunks(), dim)
            first = held.column("key").to_numpy()
            ids = held.column("ids").to_pylist()
            for key, q in zip(asking.column("key").to_pylist(), matrix(asking.column("embedding").combine_chunks(), dim)):
                score = np.sqrt(((points - q) ** 2).sum(1))
                best = np.arange(len(score)) if len(score) <= k + 1 else np.flatnonzero(score <= np.partition(score, k)[k])
                for i in best[np.lexsort((first[best], score[best]))][: k + 1]:
                    out["query"] += [key] * len(ids[i])
                    out["vec_id"] += ids[i]
                    out["score"] += [float(score[i])] * len(ids[i])
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    def search(probing: DataFrame, reach: Reach) -> DataFrame:
        probed = listed(probing.select("key", "embedding"), index, dim, reach.probes, reach.ratio, reach, "key long")
        probed = probed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = probed.groupBy("list", "salt").cogroup(posted.groupBy("list", "salt")).applyInArrow(rank, "query long, vec_id long, score double")
        order = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        top = found.distinct().withColumn("_n", order).filter(F.col("_n") <= k + 1)
        top = top.groupBy(F.col("query").alias("key")).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
        return materialize(top, "found")

    top = search(probing, reach)
    while reach.probes < len(built.centroids):
        whole = top.filter(F.size("near") >= min(k + 1, held_ids))
        short = materialize(probing.join(whole, "key", "left_anti"), "short")
        if short.isEmpty():
            break
        reach = replace(reach, probes=8 * reach.probes, floor=8 * reach.probes)
        top = whole.unionByName(search(short, reach))
    top = materialize(top.join(asked.groupBy("key").agg(F.count("*").alias("asking")), "key"), "nearest")
    mine = lookup_join(asked.select("vec_id", "key"), top, ["key"], "asking").withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
