"""Bytes of repeated passages, found with suffix arrays over shards of the corpus.

Every string of `length` bytes is given an anchor, the smallest hash of the runs of RUN bytes inside it, so equal
strings have equal anchors wherever they stand. Neighbouring strings with one anchor make a region. Only regions
whose anchor occurs again can hold a repeated string:

- Regions of equal content are one class. If it has several members, all of their strings are repeated.
- One region of each class goes to the shard of its anchor. There a suffix array is built by doubled ranks, or by
  induced sorting where repeats are long, and common prefixes with the neighbour in suffix order tell which strings occur twice.
- An anchor with more than HOT classes, such as the edge of a passage that stands in very many documents, would
  overload its shard. Its strings are counted by a 128-bit hash instead, each on its own, in a plain aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.plans.lookup import split_join
from tidelog.session import materialize

from .common import documents, text_chunks
from .suffixes import permuted_common_prefixes, suffix_array
from .supermin import mix

RUN = 64
#: Classes per anchor that a shard takes.
HOT = 4096
SHARD_BYTES = 2 << 20
#: Texts longer than this are worked on in pieces.
PIECE = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial modulo 2**64 over the bytes, and the inverse powers that bring a part to the front."""
    n = len(data) + 1
    if which not in _known or len(_known[which][0]) < n:
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(max(n, 1 << 17), base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _known[which] = tuple(tables)
    power, inverse = _known[which]
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: n - 1], dtype=np.uint64, out=sums[1:])
    return sums, inverse[:n]


def window_hashes(sums: np.ndarray, inverse: np.ndarray, width: int) -> np.ndarray:
    return mix((sums[width:] - sums[:-width]) * inverse[: len(sums) - width])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, np.uint64(2**64 - 1))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor, start, number of strings, content hash of each region of the bytes."""
    run = min(RUN, length)
    sums, inverse = prefix_hashes(data)
    hashes = window_hashes(sums, inverse, run)
    anchors = sliding_least(hashes, length - run + 1)
    # A region ends where its anchor falls out of the window or a smaller hash comes in, so each place of an anchor
    # has its own, also where a text repeats itself.
    left = hashes[: len(anchors) - 1] == anchors[:-1]
    starts = np.flatnonzero(np.append(True, left | (anchors[1:] != anchors[:-1])))
    strings = np.diff(np.append(starts, len(anchors)))
    content = mix((sums[starts + strings + length - 1] - sums[starts]) * inverse[starts] + strings.astype(np.uint64) * _GOLD)
    return anchors[starts].view(np.int64), starts, strings, content.view(np.int64)


def find_regions(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key, anchor, start, strings, content: every region of every document."""

    def find(batches):
        for batch in text_chunks(batches, limit=2 << 20):
            rows, parts = [], []
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                for at in range(0, len(data) - length + 1, PIECE):
                    anchor, start, strings, content = regions(data[at : at + PIECE + length - 1], length)
                    parts.append((anchor, start + at, strings, content))
                    rows.append(np.full(len(anchor), i))
            if rows:
                ids = batch.select(["doc_id", "key"]).take(pa.array(np.concatenate(rows)))
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*ids.columns, *columns], ["doc_id", "key", "anchor", "start", "strings", "content"])

    return docs.mapInArrow(find, "doc_id long, key long, anchor long, start long, strings long, content long")


def same_document(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def with_lists(docs: DataFrame, rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """`docs` with `list`, the `columns` of the rows of each document; text is shuffled for it, at every size."""
    lists = rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*columns)).alias("list"))
    lists = materialize(lists, "lists")
    return docs.alias("d").join(lists.alias("l"), same_document("d", "l"), how).select("d.doc_id", "d.key", "d.text", "l.list")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """shard, hot, multiple, doc_id, key, start, data: the bytes of the wanted regions."""

    def cut(batches):
        for batch in text_chunks(batches, limit=2 << 20):
            out: dict[str, list] = {c: [] for c in ("shard", "hot", "multiple", "doc_id", "key", "start", "data")}
            for doc_id, key, text, wishes in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "list"))):
                data = text.as_buffer()
                for w in wishes.as_py():
                    out["data"].append(data[w["start"] : w["start"] + w["strings"] + length - 1].to_pybytes())
                    out["doc_id"].append(doc_id.as_py())
                    out["key"].append(key.as_py())
                    for c in ("shard", "hot", "multiple", "start"):
                        out[c].append(w[c])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("hot", pa.bool_()), ("multiple", pa.bool_()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("data", pa.binary())]))

    cells = with_lists(docs, wanted, ["shard", "hot", "multiple", "start", "strings"], "inner")
    return cells.mapInArrow(cut, "shard long, hot boolean, multiple boolean, doc_id long, key long, start long, data binary")


SPANS = "doc_id long, key long, start long, end long"


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edge[::2], edge[1::2]


def repeated_in_shard(shard: pa.Table, length: int) -> pa.Table:
    """Spans of the shard's regions whose strings stand at another place of the shard too."""
    data = shard.column("data").to_pylist()
    sizes = np.array([len(d) for d in data])
    # Symbol 1 parts regions and 0 ends the text; a common prefix of `length` bytes can't reach over a border.
    text = np.frombuffer(b"\0".join(data) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 1
    text = np.append(text, 0)
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)[order]
    again = np.zeros(len(text), bool)
    again[order] = np.maximum(shared, np.append(shared[1:], 0)) >= length
    firsts = ends - sizes - 1
    whole = shard.column("multiple").to_numpy()
    owner = np.repeat(np.arange(len(data)), sizes + 1)
    room = np.append(np.repeat(ends - 1, sizes + 1) - np.arange(len(owner)) >= length, False)
    # Classes of several members are known to be repeated throughout.
    a, b = runs_of(again & room & ~np.append(whole[owner], True))
    row = owner[a]
    chosen = shard.select(["doc_id", "key", "start"]).take(pa.array(row))
    start = chosen.column("start").to_numpy() + a - firsts[row]
    return pa.table({"doc_id": chosen.column("doc_id"), "key": chosen.column("key"), "start": pa.array(start, pa.int64()), "end": pa.array(start + (b - a) + length - 1, pa.int64())})


def repeated_in_hot(cut: DataFrame, length: int) -> DataFrame:
    """Spans of strings that occur twice among all regions of hot anchors, by their hashes alone."""

    def hashes(batches):
        for batch in batches:
            for doc_id, key, start, multiple, data in zip(*(batch.column(c) for c in ("doc_id", "key", "start", "multiple", "data"))):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                pair = [pa.array(window_hashes(*prefix_hashes(raw, k), length).view(np.int64)) for k in (0, 1)]
                n = len(pair[0])
                fixed = [pa.array([v.as_py()] * n, t) for v, t in ((doc_id, pa.int64()), (key, pa.int64()), (multiple, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n) + start.as_py(), pa.int64()), *pair], ["doc_id", "key", "multiple", "start", "h", "g"])

    strings = cut.mapInArrow(hashes, "doc_id long, key long, multiple boolean, start long, h long, g long")
    twice = strings.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1")
    twice = materialize(twice, "hot-strings")
    met = split_join(strings.filter("NOT multiple"), twice, ["h", "g"], "n")
    return met.select("doc_id", "key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key, start, end: bytes covered by strings of `length` bytes that start anywhere else too; they overlap."""
    found = materialize(find_regions(docs, length), "regions")
    anchors = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    shared = materialize(split_join(found, anchors, ["anchor"], "n").drop("n"), "shared-regions")
    same = ["anchor", "content", "strings"]
    first = F.min(F.struct("doc_id", "key", "start"))
    classes = materialize(shared.groupBy(*same).agg(F.count("*").alias("n"), first.alias("first")), "classes")
    copies = split_join(shared, classes.filter("n > 1").select(*same, "n"), same, "n")
    whole = copies.select("doc_id", "key", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("end"))

    several = materialize(classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1"), "open-anchors")
    open_classes = split_join(classes, several, ["anchor"], "classes")
    size = open_classes.agg(F.sum(F.col("strings") + length)).first()[0] or 0
    wanted = open_classes.select(
        "first.*",
        "strings",
        F.pmod(F.xxhash64("anchor"), F.lit(1 + size // SHARD_BYTES)).alias("shard"),
        (F.col("classes") > HOT).alias("hot"),
        (F.col("n") > 1).alias("multiple"),
    )
    cut = materialize(cut_out(docs, wanted, length), "cut")
    in_shards = cut.filter("NOT hot").groupBy("shard").applyInArrow(lambda t: repeated_in_shard(t, length), SPANS)
    return whole.unionByName(in_shards).unionByName(repeated_in_hot(cut.filter("hot"), length))


def drop_repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, spans, kept per row of `docs`.

    A byte goes if it lies in a string of `length` bytes of its text that starts anywhere else in the corpus, in
    the same text or another; strings are judged on the input. `spans` are the maximal runs of removed bytes
    (start, end exclusive), `kept` the bytes that remain, which need not be valid UTF-8. A null text is empty;
    texts shorter than `length` stay whole; repeated rows count as places of their own; null ids are kept; other
    columns are not read. Strings never run over the end of a text.

    What is shuffled is a row per region (about one in 170 bytes), the bytes of one region per class that may hold a
    repeated string, and the texts, twice, to meet their regions and their spans.
    """
    docs = documents(docs).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(docs, length)

    def keep(batches):
        for batch in text_chunks(batches, limit=2 << 20):
            sizes, runs, kept = [], [], []
            for text, cells in zip(batch.column("text"), batch.column("list")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                merged: list[list[int]] = []
                if cells.is_valid:
                    values = cells.values
                    order = np.argsort(values.field("start").to_numpy(), kind="stable")
                    for a, b in zip(values.field("start").to_numpy()[order].tolist(), values.field("end").to_numpy()[order].tolist()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                parts, at = [], 0
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                sizes.append(len(data))
                runs.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(parts))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    cells = with_lists(docs, spans, ["start", "end"], "left")
    return cells.mapInArrow(keep, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
