"""Phrases whose words stand together more often than chance would have it.

Every word starts one window: itself and the next four words of its piece, padded with nulls at the piece's end. Only
these longest windows are counted. A phrase occurs wherever it is the beginning of a window, so a ROLLUP over the five
columns, which sums ever shorter beginnings, gives the frequency of every phrase of one to five words at once, and in
its last row the number of words.

Most windows are met once, and none of them matters beyond its frequent beginning. Before, pairs of neighbouring words
are counted by hash in a table of bounded size, then the longer beginnings of windows whose pairs are frequent. What
falls in a slot that stays below the least frequency is rarer still, so no phrase of interest holds it and a window is
padded from there on. The cut is exact whatever the tables' size: a slot that much falls in just cuts less. Tables grow
with the text up to MOST_BITS; far beyond 50 GB of text for a least frequency of 100 they cut ever less, and in the end
every distinct window is shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.session import materialize

from .common import small, text_chunks

LONGEST = 5
LEAST = 100
TOP = 2000
#: Slots of a table as a power of two, bytes of text for each slot, and in how many rows a task hands its table on.
LEAST_BITS, MOST_BITS = 16, 27
SLOT_TEXT = 48
SLICES = 256
#: A slot counts up to here; a higher least frequency is judged by this one, which cuts less.
FULL = 255
#: Bytes of text that are tokenised at once.
STRETCH = 8 << 20
#: In how many parts the best phrases of a language are looked for.
PARTS = 64

_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_SPACE, _END = 0x20, 0x0A
_BYTES = bytes(_END if c in b".,;:!?\n\x0b\x0c\r" else _SPACE if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = re.compile(rb"[ \n]")
_AHEAD = re.compile(rb"(?: *[^ \n]+){0,%d}" % (LONGEST - 1))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _stretches(data: bytes):
    """(bytes, how many of them are its own): stretches that end between words, with the words that windows reach into."""
    start = 0
    while start < len(data):
        found = _BREAK.search(data, min(start + STRETCH, len(data)))
        end = found.start() if found else len(data)
        yield data[start : _AHEAD.match(data, end).end()], end - start
        start = end


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * _SPREAD + right) * _SPREAD
    return (mixed ^ (mixed >> np.uint64(29))) * _SPREAD


def _is_set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Tokens:
    """Words of one stretch of text in one language: numbers into `vocabulary`, and which piece each stands in."""

    def __init__(self, data: bytes, own: int):
        raw = np.frombuffer(data, np.uint8)
        inside = (raw != _SPACE) & (raw != _END)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(raw == _END)[starts] if len(starts) else starts
        #: Windows that begin here, the rest only being looked into.
        self.n_own = int(np.searchsorted(starts, own))

    def beginnings(self, lang: str, tables: list[np.ndarray], bits: int):
        """(j, at, slots) for j from 1: the own words whose windows reach their word j, by what `tables` say, and the
        slots of those beginnings. The first table is of pairs, the second of longer beginnings."""
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary.to_pylist()], np.uint64)[self.codes]
        at, chain = np.arange(self.n_own), hashes[: self.n_own]
        for j in range(1, LONGEST):
            fits = at + j < len(self.codes)
            at, chain = at[fits], chain[fits]
            on = self.piece[at + j] == self.piece[at]
            mixed = _mix(chain, hashes[at + j])
            if tables:
                on &= _is_set(tables[0], _mix(hashes[at + j - 1], hashes[at + j]), bits)
            if j > 1 and len(tables) > 1:
                on &= _is_set(tables[1], mixed, bits)
            at, chain = at[on], mixed[on]
            yield j, at, chain >> np.uint64(64 - bits)

    def windows(self, beginnings) -> tuple[np.ndarray, np.ndarray]:
        """(rows of up to five codes, -1 as padding; how often each occurs) from what `beginnings` gives."""
        table = np.full((self.n_own, LONGEST), -1, np.int64)
        table[:, 0] = self.codes[: self.n_own]
        for j, at, _ in beginnings:
            table[at, j] = self.codes[at + j]
        single = table[:, 1] < 0
        alone = np.bincount(table[single, 0], minlength=len(self.vocabulary))
        words = np.flatnonzero(alone)
        ones = np.full((len(words), LONGEST), -1, np.int64)
        ones[:, 0] = words
        longer = table[~single]
        longer = longer[np.lexsort(longer.T[::-1])]
        first = np.flatnonzero(np.concatenate([[True], (longer[1:] != longer[:-1]).any(axis=1)])) if len(longer) else np.empty(0, np.int64)
        times = np.diff(np.concatenate([first, [len(longer)]]))
        return np.vstack([ones, longer[first]]), np.concatenate([alone[words], times])


def _tokens(batches):
    """(lang, tokens) of all texts of a chunk in one language at a time."""
    for part in text_chunks(batches, limit=STRETCH):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            if text:
                by_lang.setdefault(lang, []).append(text.encode().translate(_BYTES))
        for lang, texts in by_lang.items():
            for data, own in _stretches(b"\n".join(texts)):
                yield lang, _Tokens(data, own)


def _count_slots(tables, bits: int, full: int):
    """Occurrences by slot: of pairs if there are no tables yet, else of longer beginnings."""

    def run(batches):
        held = np.zeros(1 << bits, np.uint8)
        for lang, tokens in _tokens(batches):
            for j, _, slots in tokens.beginnings(lang, [t.value for t in tables], bits):
                if (j > 1) == bool(tables):
                    slot, times = np.unique(slots, return_counts=True)
                    held[slot] = np.minimum(held[slot] + np.minimum(times, full), full)
                elif j > 1:
                    break
        for i, part in enumerate(held.reshape(min(SLICES, len(held) // 8), -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    return run


def _add_up(full: int, packed: bool = False):
    """Sums of the slices that arrive, or a bit per slot that is full; what is held is the table at most."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, np.uint8)
                held[i] = np.minimum(held[i].astype(np.int64) + counts, full).astype(np.uint8) if i in held else counts
        for i, counts in held.items():
            counts = np.packbits(counts >= full, bitorder="little") if packed else counts
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["slice", "counts"])

    return run


def frequent_slots(texts: DataFrame, tables: list, least: int, bits: int) -> np.ndarray:
    """One bit per slot, packed: does what falls in it occur `least` times together?"""
    full, shape = min(least, FULL), "slice int, counts binary"
    counted = texts.mapInArrow(_count_slots(tables, bits, full), shape).withColumn("salt", F.spark_partition_id() % 16)
    some = counted.repartition(F.col("slice"), F.col("salt")).select("slice", "counts").mapInArrow(_add_up(full), shape)
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(min(SLICES, (1 << bits) // 8), -1)
    for row in some.repartition(F.col("slice")).mapInArrow(_add_up(full, packed=True), shape).collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def _windows(tables, bits: int):
    def run(batches):
        for lang, tokens in _tokens(batches):
            rows, times = tokens.windows(tokens.beginnings(lang, [t.value for t in tables], bits))
            for i in range(0, len(rows), 50_000):
                part, n = rows[i : i + 50_000], times[i : i + 50_000]
                words = [tokens.vocabulary.take(pa.array(c, mask=c < 0)).cast(pa.string()) for c in part.T]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *words, pa.array(n)], ["lang", *_WORDS, "c"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, k, phrase, f) of every phrase of one to five words met `least` times, and (lang, 0, null, n) with all words.

    Null texts are empty, a null language is `und`. `bits` sizes the tables, by the bytes of text unless given.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max(round(math.log2(size / SLOT_TEXT + 1)), LEAST_BITS), MOST_BITS)
    tables: list = []
    for _ in range(2):
        tables.append(spark.sparkContext.broadcast(frequent_slots(texts, list(tables), least, bits)))
    windows = texts.mapInArrow(_windows(tables, bits), ", ".join(f"{c} string" for c in ("lang", *_WORDS)) + ", c long")
    counted = windows.groupBy("lang", *_WORDS).agg(F.sum("c").alias("c"))
    level = F.grouping_id()
    summed = counted.rollup("lang", *_WORDS).agg(F.sum("c").alias("f"), level.alias("rolled"))
    # Rolled up are the last columns: their number gives the phrase's length, -1 the total over all languages.
    k = F.lit(LONGEST) - F.log2(F.col("rolled") + 1).cast("int")
    summed = summed.withColumn("k", k).filter((F.col("k") >= 0) & ((F.col("k") == 0) | (F.col("f") >= least)))
    last = F.get(F.array(*_WORDS), F.col("k") - 1)
    summed = summed.filter((F.col("k") == 0) | last.isNotNull())
    phrase = F.when(F.col("k") > 0, F.concat_ws(" ", *_WORDS))
    counts = materialize(summed.select("lang", "k", phrase.alias("phrase"), "f"), "phrase-counts")
    for t in tables:
        t.unpersist()
    return counts


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): every phrase of two words or more with its worst cut."""
    words = F.split("phrase", " ")
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("k > 0").select("lang", F.col("phrase").alias("part"), "f")
    cuts = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, 1, F.col("cut")).alias("head"), _part(words, F.col("cut") + 1, F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(small(totals), "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    # A score is below 1000 n, as a is at most l and r, so its quotient fits 64 bits where its products need not.
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst)
    return scored.select("lang", "phrase", words.alias("words"), "a", "worst.l", "worst.r", "n", "worst.score")


def without_parts(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer one holds as often as they occur."""
    words, size = F.col("words"), F.size("words")
    runs = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice(words, at, n), " ")))
    )
    inner = candidates.filter(size > 2).select("lang", F.explode(F.array_distinct(runs)).alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < 100 * F.col("a")))
    return kept.drop("longest")


def _first(df: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of each language.

    No rows for an empty table or one without a phrase met `least` times. The best of a language are first found
    within parts of its phrases, so that no task orders all of them.
    """
    candidates = materialize(score_candidates(phrase_counts(docs, least, bits)), "candidates")
    kept = without_parts(candidates).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = _first(_first(kept, ["lang", "part"], top), ["lang"], top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM i),
t AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
f AS MATERIALIZED (SELECT lang, w[i:i + k - 1] AS w, count(*) AS f FROM o GROUP BY ALL HAVING f >= {LEAST}),
c AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (
  SELECT c.lang, c.w, c.a, x.f AS l, y.f AS r, t.n, c.k, (1000 * c.a::HUGEINT * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.w = c.w[:c.k] JOIN f y ON y.lang = c.lang AND y.w = c.w[c.k + 1:] JOIN t ON t.lang = c.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
u AS (SELECT lang, w, a, unnest(range(2, len(w))) AS m FROM b),
v AS (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM u),
h AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS longest FROM v GROUP BY ALL),
d AS (
  SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, n, score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.w = b.w WHERE longest IS NULL OR 100 * longest < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d QUALIFY rank <= {TOP}
"""
