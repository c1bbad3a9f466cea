"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find.

1. Every document becomes a sketch: size and key of its shingle set, and the band keys of its signature.
   Documents with equal sets are one class from here on; a class is a node.
2. Classes that share a band key meet in a bucket. Each bucket's smallest class is compared with the others,
   on full sets, and linked classes are united. That is a number of pairs in proportion to the bucket.
3. In buckets whose classes are then of several components, the pairs across components remain. They are ruled
   out by size and by a second, longer signature, in blocks of bounded size; what is left is verified as well.
4. Components of all verified links; the smallest document id of a component names it.

A pair at the threshold shares no band with a probability of two in a million, and is misjudged by its longer
signature with one in ten million; no other step can lose a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.plans.lookup import fits_broadcast, lookup_join
from tidelog.session import materialize

from . import supermin
from .common import documents, small, text_chunks, texts
from .components import components

PERCENT = 85
#: Members of one block of an open bucket.
BLOCK = 512

#: Slots of the signatures that rule out pairs; a byte each, only for classes that share a band key with another.
LONG = 1024
SKETCH = "doc_id long, n_shingles long, node long, bands array<long>"


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A sketch per row; `node` is a 64-bit key of the shingle set, null for an empty one."""
    n_bands, n_rows = supermin.banding(percent)

    def sketch(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            sets = supermin.shingle_sets(texts(batch), shingle)
            full = [s for s in sets if len(s)]
            keys, bands = [], []
            for a, b in supermin.chunked(full, n_bands * n_rows):
                sigs = supermin.signatures(full[a:b], n_bands * n_rows)
                keys += [int.from_bytes(supermin.set_key(s)[:8], "little", signed=True) for s in full[a:b]]
                bands += list(supermin.band_keys(sigs, n_bands))
            at = iter(range(len(full)))
            place = [next(at) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if i is None else keys[i] for i in place], pa.int64()),
                    pa.array([None if i is None else bands[i] for i in place], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "bands"],
            )

    return docs.mapInArrow(sketch, SKETCH)


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node, elements (packed sorted uint64), brief (long signature) of the documents with these ids, one row per node."""
    ids = F.broadcast(ids) if fits_broadcast(ids) else ids
    wanted = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi")

    def pack(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            sets = [s for s in supermin.shingle_sets(texts(batch), shingle) if len(s)]
            keys = [int.from_bytes(supermin.set_key(s)[:8], "little", signed=True) for s in sets]
            briefs = [row.tobytes() for a, b in supermin.chunked(sets, 2 * LONG) for row in supermin.brief(supermin.signatures(sets[a:b], LONG))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(briefs, pa.binary())],
                ["node", "elements", "brief"],
            )

    return wanted.mapInArrow(pack, "node long, elements binary, brief binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets overlap enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def ordered_pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def comparable(n, m, percent: int):
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def across_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components within a bucket that their sizes and brief signatures allow.

    `members`: bucket, node, n, root. `sets`: node, brief, bands. Only buckets of several components are looked at,
    and a pair comes from the first of the bands it shares alone. A bucket of more than
    BLOCK members is cut into blocks, and every two blocks meet in a row of their own, so that a row never holds
    more than about two blocks, however large the bucket.
    """
    least = supermin.least_estimate(percent, LONG)
    open_buckets = (
        members.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
        .filter("low <> high")
        .select("bucket", "size")
    )
    open_buckets = materialize(open_buckets, "open-buckets")
    rows = lookup_join(members.select("bucket", "node", "n", "root"), open_buckets, ["bucket"], "size")
    rows = rows.join(sets.select("node", "brief", "bands"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = (
        rows.groupBy("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(F.struct("node", "n", "root", "brief", "bands", "own")).alias("rows"))
        .filter("size(rows) > 1")
        .select("bucket", "i", "j", "rows")
    )

    def compare(batches):
        for batch in batches:
            for bucket, i, j, rows in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), batch.column("rows")):
                block = rows.values
                node, n, root, own = (block.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "root", "own"))
                sigs = np.frombuffer(b"".join(block.field("brief").to_pylist()), np.uint8).reshape(len(node), -1)
                bands = block.field("bands").flatten().to_numpy().reshape(len(node), -1)
                found_a, found_b = [], []
                for k in range(len(node) - 1):
                    fit = (root[k + 1 :] != root[k]) & (100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k]))
                    if i != j:
                        fit &= own[k + 1 :] != own[k]
                    at = np.flatnonzero(fit) + k + 1
                    at = at[supermin.estimated(sigs[at], sigs[k]) >= least]
                    shared = bands[k][(bands[at] == bands[k]).argmax(1)] if len(at) else at
                    at = at[shared == bucket]
                    found_a.append(np.minimum(node[at], node[k]))
                    found_b.append(np.maximum(node[at], node[k]))
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def group_near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per row of `docs`.

    A document's set are its distinct runs of `shingle` words, or all its words as one run if it has fewer. Two
    documents are linked if their sets' Jaccard similarity is `percent` per cent or more; sets hold 64-bit hashes.
    component_id is the smallest id that links lead to, the document's own included. Null and empty texts have an
    empty set and no links. Equal texts under several ids are linked; null ids never name a component that has
    another. Other columns are not read; an empty table gives an empty result.
    """
    docs = documents(docs)
    drawn = materialize(sketches(docs, shingle, percent), "sketches")
    classes = materialize(
        drawn.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"),
            F.any_value("n_shingles").alias("n"),
            F.count("*").alias("copies"),
            F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    banded = classes.select("node", "n", "rep", F.explode("bands").alias("bucket"))
    first = F.min(F.struct("rep", "node", "n"))
    leaders = banded.groupBy("bucket").agg(first.alias("first"), F.count("*").alias("size")).filter("size > 1")
    leaders = materialize(leaders.select("bucket", "size", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n")), "leaders")
    members = materialize(lookup_join(banded, leaders, ["bucket"], "size"), "members")

    sets = sets_of(docs, members.select("rep").distinct(), shingle)
    sets = materialize(sets.join(classes.select("node", "bands"), "node"), "sets")
    near = members.filter((F.col("node") != F.col("leader")) & comparable(F.col("n"), F.col("leader_n"), percent))
    star = materialize(near.select(*ordered_pair(F.col("node"), F.col("leader"))).distinct(), "star-pairs")
    links = materialize(verified(star, sets, percent), "star-links")
    roots = components(links)

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = across_components(placed, sets, percent).join(star, ["a", "b"], "left_anti")
    late = materialize(verified(more, sets, percent), "late-links")
    if not late.isEmpty():
        roots = components(links.unionByName(late))

    # Every class that has several documents or a link; all others name themselves.
    held = classes.join(roots, "node", "left").filter("root IS NOT NULL OR copies > 1")
    held = held.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    names = held.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(held.join(names, "root").select("node", "copies", "component_id"), "components")
    out = lookup_join(drawn.select("doc_id", "n_shingles", "node"), named, ["node"], "copies", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` per group of near duplicates, that of the smallest id; all columns stay.

    Rows are told apart by a number of their own: of repeated rows one stays, an id that several texts share stands
    for each of them, and a row without an id stays only if no row of its group has one. Rows without words all stay.
    """
    tag = "_row"
    while tag in docs.columns:
        tag += "_"
    tagged = materialize(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged")
    grouped = group_near_duplicates(tagged.select(F.col(tag).alias("doc_id"), "text"), shingle, percent)
    grouped = grouped.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
    ids = tagged.select(F.col(tag).alias("row"), F.col("doc_id").cast("long").alias("id"))
    members = materialize(grouped.join(ids, "row"), "near-copies")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first")
    groups = members.groupBy("root").agg(F.count("*").alias("n"), first).filter("n > 1").select("root", F.col("first.row").alias("stays"))
    gone = members.join(groups, "root").filter("row <> stays").select(F.col("row").alias(tag))
    return tagged.join(small(materialize(gone, "gone")), tag, "left_anti").drop(tag)


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 2], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= {PERCENT} * (p.n + q.n - i)
),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
