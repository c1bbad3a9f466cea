"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's score is that of its highest scoring window: every text is read whole, in windows of fixed length that
overlap by half, so a score doesn't follow from a text's length. An n-gram counts once per window. Its feature value
is the log ratio of its document frequencies among toxic and other labelled texts, so that logistic regression, whose
penalty is the same for all weights, moves the telling n-grams first. Only n-grams that speak for toxicity are
features, with weights that are not negative. A first fit to whole documents says which windows of a document stand
out; the second one is to these windows. N-grams are hashed into a table of
fixed size, which holds one n-gram a bucket and the rest of its hash, so that others of the bucket don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.session import materialize

from .common import documents, text_chunks, texts

BITS = 20
ORDERS = (4, 5, 6)
PAD = b"\0" * max(ORDERS)
#: Windows begin every STRIDE bytes and hold the n-grams that begin in twice as many.
STRIDE = 64
#: Windows of a labelled document that the model is fitted to.
WINDOWS = 8


@dataclass(frozen=True)
class Toxicity:
    weights: np.ndarray  # by bucket; 0 for buckets that are no features
    bias: float
    rests: np.ndarray  # by bucket; the bits of the feature's hash that don't name the bucket


def joined(chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the padded texts, and where each text ends; letters' case makes no difference."""
    raw = [PAD + t.lower().encode("utf-8", "replace") + PAD for t in chunk]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def hashes(flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(whether it lies within one text, hash) of the n-gram that begins at each byte, one order at a time."""
    h = np.zeros(len(flat), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            # An n-gram that begins at the very end of one padded text would reach into the next one.
            inside = np.ones(len(h), bool)
            for k in range(1, n):
                inside[np.minimum(ends[:-1] - k, len(h) - 1)] = False
            yield inside, h * np.uint32(0x9E3779B1)


def distinct(groups: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs, sorted; values have up to 32 bits."""
    found = np.concatenate([g.astype(np.int64) << 32 | v for g, v in zip(groups, values)])
    found.sort()
    found = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
    return found >> 32, found & 0xFFFFFFFF


def grams(chunk: list[str], chosen: np.ndarray | None, rests: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Where texts end, and place and hash of every n-gram, of the chosen buckets and with their rests only if given."""
    flat, ends = joined(chunk)
    places, values = [], []
    for inside, h in hashes(flat, ends):
        if chosen is not None:
            inside &= chosen[h >> np.uint32(32 - BITS)]
        at = np.flatnonzero(inside)
        value = h[at]
        if rests is not None:
            same = rests[value >> np.uint32(32 - BITS)] == rest_of(value)
            at, value = at[same], value[same]
        places.append(at)
        values.append(value)
    return ends, places, values


def rest_of(value):
    return value & ((1 << (32 - BITS)) - 1)


def features(chunk: list[str], chosen: np.ndarray | None, rests: np.ndarray | None = None, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs, or those of (document, hash)."""
    ends, places, values = grams(chunk, chosen, rests)
    return distinct([np.searchsorted(ends, p, "right") for p in places], values if whole else [v >> np.uint32(32 - BITS) for v in values])


def windows(chunk: list[str], chosen: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first window of each document and after the last one's end, and distinct (window, bucket) pairs."""
    ends, places, values = grams(chunk, chosen, rests)
    starts = np.append(0, ends[:-1])
    first = np.append(0, np.cumsum((ends - starts - 1) // STRIDE + 2))
    groups = []
    for p in places:
        doc = np.searchsorted(ends, p, "right")
        groups.append(first[doc] + (p - starts[doc]) // STRIDE)
    # An n-gram belongs to the window that begins in its stretch of STRIDE bytes and to the one before.
    values = [v >> np.uint32(32 - BITS) for v in values]
    return first, *distinct([g + k for k in (0, 1) for g in groups], values * 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of at most `most` labelled documents, chosen by a hash of their ids; rows kept for testing are left out.

    A document labelled more than once is toxic if any label says so.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(most)
    )
    # At most `most` rows of twelve bytes: safe to broadcast.
    return documents(docs).join(F.broadcast(marks), "doc_id").select("text", "toxic")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, tasks: int = 8, least_z: float = 2.5, most_features: int = 2048) -> Toxicity:
    """Fit to a sample of at most `most` labelled documents.

    `tasks` tasks count one part of the sample each, Spark adds up and picks the buckets whose log ratio is the most
    standard errors above nothing, at least `least_z` and at most `most_features` of them, and then in the same way
    the one n-gram of each. Those, and per document the few of them it has, in the whole and in the windows that
    stand out, are all that reaches the driver.
    """
    sample = materialize(labelled_sample(docs, labels, most).repartition(tasks), "toxicity-sample").coalesce(tasks)

    def count(batches):
        tables = np.zeros((2, 1 << BITS), np.int32)
        for batch in text_chunks(batches, limit=1 << 20):
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            doc, bucket = features(texts(batch), None)
            for k in (0, 1):
                tables[k] += np.bincount(bucket[label[doc] == k], minlength=1 << BITS).astype(np.int32)
        found = np.flatnonzero(tables.any(0))
        for start in range(0, len(found), 50_000):
            part = found[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(t[part]) for t in tables)], ["gram", "other", "toxic"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        bias = float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 1.5)))
        return Toxicity(np.zeros(1 << BITS, np.float32), bias, np.zeros(1 << BITS, np.uint16))

    def telling(counter) -> DataFrame:
        seen = sample.mapInArrow(counter, "gram long, other int, toxic int").groupBy("gram")
        seen = seen.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).filter("other + toxic >= 5")
        ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
        return seen.select("gram", ratio.alias("ratio"), (ratio / error).alias("z")).filter(F.col("z") >= least_z)

    best = telling(count).orderBy(F.desc("z"), "gram").limit(most_features).toArrow()
    crowd = np.zeros(1 << BITS, bool)
    crowd[best.column("gram").to_numpy()] = True

    def count_chosen(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            doc, value = features(texts(batch), crowd, whole=True)
            names, at = np.unique(value, return_inverse=True)
            sums = [np.bincount(at[label[doc] == k], minlength=len(names)).astype(np.int32) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, sums)], ["gram", "other", "toxic"])

    # One n-gram of each bucket, that of the largest z.
    bucket = F.shiftright("gram", 32 - BITS)
    best = telling(count_chosen).groupBy(bucket.alias("bucket")).agg(F.max(F.struct("z", "gram", "ratio")).alias("m")).select("m.gram", "m.ratio").toArrow()
    gram = best.column("gram").to_numpy()
    ratio, rests = np.zeros(1 << BITS), np.zeros(1 << BITS, np.uint16)
    ratio[gram >> (32 - BITS)] = best.column("ratio").to_numpy()
    rests[gram >> (32 - BITS)] = rest_of(gram)
    chosen = ratio != 0

    def design(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            doc, bucket = features(texts(batch), chosen, rests)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "buckets"])

    rows = sample.mapInArrow(design, "toxic int, buckets array<int>").toArrow()
    weights, _ = fit(*listed(rows), rows.column("toxic").to_numpy(), ratio)
    del rows

    def standing_out(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            first, window, bucket = windows(texts(batch), chosen, rests)
            z = np.bincount(window, weights[bucket], minlength=first[-1])
            out = []
            for i, toxic in enumerate(batch.column("toxic").to_pylist()):
                own = z[first[i] : first[i + 1]]
                for w in first[i] + np.argsort(-own, kind="stable")[:WINDOWS]:
                    a, b = np.searchsorted(window, [w, w + 1])
                    out.append((toxic, i, bucket[a:b]))
            # Documents are told apart by the place of their first window.
            head = np.array([k == 0 or out[k][1] != out[k - 1][1] for k in range(len(out))], bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array(head), pa.array([r[2] for r in out], pa.list_(pa.int32()))],
                ["toxic", "head", "buckets"],
            )

    rows = sample.mapInArrow(standing_out, "toxic int, head boolean, buckets array<int>").toArrow()
    label = rows.column("toxic").to_numpy()
    doc = np.cumsum(rows.column("head").to_numpy()) - 1
    return Toxicity(*fit_windows(*listed(rows), doc, label, ratio, weights), rests)


def listed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row and element of each element of the lists `buckets`."""
    lists = rows.column("buckets").combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def fit_windows(window: np.ndarray, bucket: np.ndarray, doc: np.ndarray, label: np.ndarray, ratio: np.ndarray, weights: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Fit to all windows of clean documents and those of toxic ones that so far score highest or beyond nearly all clean ones."""
    def highest(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(window, weights[bucket], minlength=len(doc))
        order = np.lexsort((-z, doc))
        top = np.zeros(len(doc), bool)
        top[order[np.append(True, doc[order][1:] != doc[order][:-1])]] = True
        return z, top

    for _ in range(rounds):
        z, top = highest(weights)
        used = top | (label == 0) | (z > np.quantile(z[top & (label == 0)], 0.99))
        place = np.cumsum(used) - 1
        at = used[window]
        weights, _ = fit(place[window[at]], bucket[at], label[used], ratio)
    # The bias is that of documents, by their highest windows: the likeliest one makes their scores' sum the toxic ones' number.
    z, top = highest(weights)
    z, toxic = z[top], np.clip(label[top].sum(), 0.5, top.sum() - 0.5)
    low, high = -100.0 - z.max(), 100.0
    for _ in range(60):
        bias = (low + high) / 2
        low, high = (low, bias) if (1 / (1 + np.exp(-np.clip(z + bias, -50, 50)))).sum() > toxic else (bias, high)
    return weights, bias


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, ratio: np.ndarray, penalty: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features, by accelerated gradient descent; weights per bucket, scale included.

    Weights are kept from falling below nothing.
    """
    place = np.zeros(1 << BITS, np.int64)
    place[bucket] = 1
    names = np.flatnonzero(place)
    place[names] = np.arange(len(names))
    at = place[bucket]
    scale = ratio[names]
    value = scale[at]
    n = len(label)

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(doc, v[at] * value, minlength=n)

    def backward(g: np.ndarray) -> np.ndarray:
        return np.bincount(at, g[doc] * value, minlength=len(names))

    # A step of one over the largest curvature, a quarter of the largest eigenvalue of the scatter matrix.
    v, top = np.full(len(names), 1.0), 1.0
    for _ in range(8):
        u = backward(forward(v))
        top = np.linalg.norm(u) / max(np.linalg.norm(v), 1e-300)
        v = u / max(np.linalg.norm(u), 1e-300)
    step = 1 / (0.25 * (1.2 * top + n) + penalty)
    w = last = np.append(np.zeros(len(names)), np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    for k in range(rounds):
        v = w + (k / (k + 3)) * (w - last)
        gap = 1 / (1 + np.exp(-np.clip(forward(v[:-1]) + v[-1], -50, 50))) - label
        slope = np.append(backward(gap) + penalty * v[:-1], gap.sum())
        last, w = w, v - step * slope
        w[:-1] = np.maximum(w[:-1], 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w[:-1] * scale
    return weights, float(w[-1])


def scores(chunk: list[str], model: Toxicity) -> np.ndarray:
    first, window, bucket = windows(chunk, model.weights != 0, model.rests)
    z = np.bincount(window, model.weights[bucket], minlength=first[-1])
    z = np.maximum.reduceat(z, first[:-1]) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def keep_clean(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of `docs` that score below 0.5; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            yield batch.filter(pa.array(scores(texts(batch), shared.value) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows and columns of `docs` with a last column `toxicity` (0 to 1, replacing one of that name).

    Only `text` is read; the score is that of the highest scoring window of the whole text. A null or empty text gets
    the score of a text without n-grams of the model. Rows are independent, nothing is shuffled, a document is read whole.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            found = scores(texts(batch), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))
