"""How filters on documents interact: what each removes, alone and in every order of application.

Five filters have 32 subsets. A document survives a subset if it fails none of its filters, so the filters it fails
make a truth table of 32 bits, its survival word: bit S tells whether it survives subset S. How many documents
survive each subset is then a count of set bits by position. Carry-save adders count them: three words become a word
of sums and a word of carries, which weigh twice as much, so a batch is counted in whole-array operations without
looking at any single bit. The 32 counts of a part of the corpus are all that orders, steps and Shapley values need.

Only keys, ids and failed filters are shuffled, never texts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.session import materialize

#: The filters in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
MIN_WORDS = 200
#: What is counted: all documents, those labelled good, those labelled toxic.
KINDS = ("all", "good", "toxic")


def survival_word(failed: int) -> int:
    """Bit S is set if no filter of S is among those that failed."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


def failures_of_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; E needs the other documents."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 2 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, good, toxic, failed, word) of every document; `word` is a 32-bit word in a long.

    Texts are equal if their SHA-256 is. A null text is empty, a null source the empty part. A document without an
    id fails filter E for no other document and is compared with none itself. Several labels of one document count
    as one that holds what any of them says.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        failures_of_text(text).alias("failed"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    facts = materialize(facts, "audit-facts")
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    first = facts.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    again = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    no = F.lit(False)
    marked = facts.join(said, "doc_id", "left").join(first, "key").select(
        "doc_id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("failed") + again).alias("failed")
    )
    table = F.array(*[F.lit(survival_word(m)).cast("long") for m in range(SUBSETS)])
    return marked.withColumn("word", F.element_at(table, F.col("failed") + 1))


def popcounts_by_position(words: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """How often each of 32 bit positions is set among the words of each group; `group` must be sorted."""
    counts = np.zeros((n_groups, SUBSETS), np.int64)
    positions = np.arange(SUBSETS, dtype=np.uint32)
    weight = 1
    while len(words):
        carries, carried = [], []
        while True:
            size = np.bincount(group, minlength=n_groups)
            place = np.arange(len(group)) - (np.cumsum(size) - size)[group]
            full = place < (size - size % 3)[group]
            head = np.flatnonzero(full & (place % 3 == 0))
            if not len(head):
                break
            a, b, c = words[head], words[head + 1], words[head + 2]
            half = a ^ b
            carries.append((a & b) | (half & c))
            carried.append(group[head])
            words = np.concatenate([half ^ c, words[~full]])
            group = np.concatenate([group[head], group[~full]])
            order = np.argsort(group, kind="stable")
            words, group = words[order], group[order]
        # Two words of this weight are left per group at most.
        np.add.at(counts, group, weight * ((words[:, None] >> positions) & 1).astype(np.int64))
        words = np.concatenate(carries) if carries else words[:0]
        group = np.concatenate(carried) if carried else group[:0]
        order = np.argsort(group, kind="stable")
        words, group = words[order], group[order]
        weight *= 2
    return counts


def _count_batches(batches):
    for batch in batches:
        parts, group = np.unique(np.array(batch.column("part").to_pylist(), object), return_inverse=True)
        order = np.argsort(group, kind="stable")
        group = group[order]
        words = batch.column("word").to_numpy().astype(np.uint32)[order]
        kinds = [words] + [np.where(batch.column(k).to_numpy(zero_copy_only=False)[order], words, np.uint32(0)) for k in KINDS[1:]]
        counts = np.hstack([popcounts_by_position(w, group, len(parts)) for w in kinds])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(parts.tolist(), pa.string()), lists], ["part", "counts"])


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, survivors): for each of KINDS, how many documents survive each of the 32 subsets, 96 numbers in all."""
    counted = words.select("part", "good", "toxic", "word").mapInArrow(_count_batches, "part string, counts array<bigint>")
    sums = [F.sum(F.get("counts", F.lit(i))) for i in range(len(KINDS) * SUBSETS)]
    return counted.groupBy("part").agg(F.array(*sums).alias("survivors"))


def _survivors(subset: Column | int, kind: str = "all") -> Column:
    return F.get("survivors", F.lit(KINDS.index(kind) * SUBSETS) + subset)


def shapley_total(letter: str) -> Column:
    """What the filter removes, summed over all orders: a subset that comes before it does so in s!(4-s)! of them."""
    bit, n = 1 << FILTERS.index(letter), len(FILTERS)
    total = F.lit(0).cast("long")
    for s in (s for s in range(SUBSETS) if not s & bit):
        size = s.bit_count()
        total = total + factorial(size) * factorial(n - 1 - size) * (_survivors(s) - _survivors(s | bit))
    return total


def audit_orders(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    orders = " ".join(map("".join, permutations(FILTERS)))
    each = survivors.select("part", "survivors", F.array(*map(shapley_total, FILTERS)).alias("shares"))
    each = each.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    order, step = F.col("filter_order"), F.col("step")
    each = each.withColumn("place", F.instr(F.lit(FILTERS), order.substr(step, F.lit(1))))
    applied = order.substr(F.lit(1), step - 1)
    before = sum((F.when(F.instr(applied, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    each = each.withColumn("bit", F.element_at(bits, F.col("place"))).withColumn("before", before)
    bit, before = F.col("bit"), F.col("before")
    after = before.bitwiseOR(bit)
    removed = _survivors(before) - _survivors(after)
    return each.select(
        "part",
        "filter_order",
        "step",
        _survivors(after).alias("kept"),
        removed.alias("removed"),
        (_survivors(0) - _survivors(bit) - removed).alias("redundant"),
        (_survivors(F.lit(ALL) - bit) - _survivors(ALL)).alias("unique_fails"),
        (_survivors(before, "good") - _survivors(after, "good")).alias("good_lost"),
        (_survivors(before, "toxic") - _survivors(after, "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("place")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders and steps of the five filters for each source; no rows for an empty table."""
    return audit_orders(subset_survivors(survival_words(docs, labels)))


_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
s AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN s USING (doc_id)
),
g AS (SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
p AS (
  SELECT filter_order, step, filter_order[step] AS x, '[' || left(filter_order, step - 1) || '0]' AS applied
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)
),
r AS (
  SELECT part, filter_order, step, x, n, n_good, n_toxic, fails, contains(fails, x) AS hit, regexp_matches(fails, applied) AS gone
  FROM g, p
),
c AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM c
"""
