"""Benchmark passages in documents, by winnowing.

Both sides hash every run of k words and keep, for each window of n words, the smallest hash of the n - k + 1 runs
inside. Equal windows keep equal hashes, so no shared window is missed. Test fingerprints meet those of the
documents through a join on the hash, and each hit is extended to its whole window, whose words must be equal.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.plans.lookup import fits_broadcast
from tidelog.session import materialize

from .common import ascii_lower, documents, repeated, without

WINDOW = 10
RUN = 7
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased; none in a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1), "")


def _sliding(df: DataFrame, column: str, width: int, combine) -> DataFrame:
    """`column` folded over `width` neighbours, by doubling; what the last `width` - 1 elements hold is of no use."""
    have = 1
    while have < width:
        step = min(have, width - have)
        rest = F.slice(column, step + 1, F.greatest(F.size(column) - step, F.lit(0)))
        df = df.withColumn(column, F.zip_with(column, rest, combine))
        have += step
    return df


def fingerprints(df: DataFrame, n: int) -> DataFrame:
    """`df`, which has `words`, with `prints`: for each window of `n` words its smallest hash of a run."""
    run = min(RUN, n)
    df = df.withColumn("prints", F.transform("words", lambda w: F.xxhash64(w)))
    df = _sliding(df, "prints", run, lambda a, b: F.xxhash64(a, b))
    df = _sliding(df, "prints", n - run + 1, lambda a, b: F.least(a, b))
    return df.withColumn("prints", F.slice("prints", 1, F.greatest(F.size("words") - (n - 1), F.lit(0))))


def window_text(n: int) -> Column:
    # No word holds a space.
    return F.array_join(F.slice("words", F.col("pos") + 1, n), " ")


def item_windows(items: DataFrame, n: int, lengths: Column) -> DataFrame:
    """fingerprint, window, ids: distinct windows of `n` words of the items whose word count meets `lengths`."""
    chosen = fingerprints(items.filter(lengths), n)
    each = chosen.select("item_id", "words", F.posexplode("prints").alias("pos", "fingerprint"))
    return (
        each.select("item_id", "fingerprint", window_text(n).alias("window"))
        .groupBy("fingerprint", "window")
        .agg(F.collect_set("item_id").alias("ids"))
    )


def hits(docs: DataFrame, windows: DataFrame, n: int, carry: bool) -> DataFrame:
    """doc_id, key, n_words, first, start, ids: a row per window of `n` words that is one of `windows`.

    With `carry`, a row comes for every document too, marked `first`, with or without a hit.
    """
    known = windows.select("fingerprint").distinct().withColumn("known", F.lit(True))
    few = fits_broadcast(windows)
    rows = fingerprints(docs, n).select(
        "doc_id", "key", "words", F.size("words").alias("n_words"), F.posexplode_outer("prints").alias("pos", "fingerprint")
    )
    first = (F.coalesce("pos", F.lit(0)) == 0) & F.lit(carry)
    if few:
        met = rows.join(F.broadcast(known), "fingerprint", "left").filter(first | F.col("known"))
        met = met.withColumn("window", F.when(F.col("known"), window_text(n)))
        windows = F.broadcast(windows.drop("fingerprint"))
    else:
        # Too many to broadcast: the window travels instead of the document's words.
        met = rows.withColumn("window", window_text(n)).drop("words")
        met = met.join(known, "fingerprint", "left").filter(first | F.col("known"))
        windows = windows.drop("fingerprint")
    met = met.select("doc_id", "key", "n_words", first.alias("first"), F.col("pos").alias("start"), "window")
    return met.join(windows, "window", "left").filter(F.col("first") | F.col("ids").isNotNull()).drop("window")


def text_key() -> Column:
    return F.struct(F.xxhash64("text"), F.octet_length("text"))


def gather_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, key, n_words, n_hit, items, copies: one row per id and text."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    listed = materialize(listed.filter(F.size("words") > 0), "benchmark-words")
    count = F.size("words")
    short = [r["n"] for r in listed.filter(count < n).select(count.alias("n")).distinct().collect()]
    texts = documents(docs).select("doc_id", text_key().alias("key"), words_of(F.col("text")).alias("words"))
    found = None
    for m, lengths in [(n, count >= n), *((m, count == m) for m in sorted(short))]:
        windows = materialize(item_windows(listed, m, lengths), "benchmark-windows")
        more = hits(texts, windows, m, carry=m == n).withColumn("end", F.col("start") + m)
        found = more if found is None else found.unionByName(more)
    hit = F.col("ids").isNotNull()
    gathered = found.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("first").cast("int")).alias("copies"),
        F.collect_set(F.when(hit, F.struct("start", "end"))).alias("spans"),
        F.flatten(F.collect_set("ids")).alias("ids"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        ),
    )["n"]
    return gathered.select(
        "doc_id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("ids")).alias("items"),
        "copies",
    )


def find_contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), contaminated: one row per row of `docs`.

    A word is hit if it lies in any occurrence of `n` consecutive words of an item; an item of fewer words, but
    not none, is one window. Null and empty texts have no words. Items without id hit, but aren't listed; items of
    one id are one. Rows of one id and text are worked on once and repeated in the result; rows of one id and
    several texts are several documents. Other columns are not read.

    Text is read once, and once more for each length below `n` that some item has; it is never shuffled. What is
    shuffled is a row per document and hit, after partial aggregation. Item windows are broadcast after their
    size was checked, else joined on the fingerprint.
    """
    found = gather_hits(docs, items, n).drop("key").withColumn("contaminated", F.col("n_hit") > 0)
    return repeated(found, "copies")


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a word that is hit; all columns stay."""
    bad = materialize(gather_hits(docs, items, n).filter("n_hit > 0"), "contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_text"))
    # A document that is hit has a text, so only its id can be null.
    key = text_key()
    return without(docs, bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (key == F.col("_text")))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))
),
h AS MATERIALIZED (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
