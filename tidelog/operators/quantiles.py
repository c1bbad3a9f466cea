"""Exact order statistics that never gather a group's values in one task.

`percentile` and `percentile_disc` keep every distinct value of a group in one
aggregation buffer.

For a whole table, rows go straight into a histogram of bounded size, whose
partial counts are all that is shuffled; the bucket of a wanted rank is cut
into slices by another pass over the rows, and so on until a bucket holds one
value. Each pass cuts a bucket's width by thousands, so a handful suffice for
any distribution, and no task ever orders values.

Per group it is the same, with a table of one row per group and wanted rank in
place of the driver's list: every pass counts, for all groups at once, the
slices of the buckets that are still open. Partial counts are all that is
shuffled, so a group that holds most rows is no task's burden. A bucket is open
until it holds one value or few enough rows to be put in order, at most as many
as it would have slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Buckets per doubling of the value, and slices of one such bucket.
PER_OCTAVE = 128
SLICES = 4096
# |value| above 2^1024 does not occur in a double, so buckets are bounded.
MAX_OCTAVES = 1100


def _octave_bucket(v: Column) -> Column:
    """Bucket number that never decreases as the value grows."""
    depth = F.floor(F.least(F.log2(F.abs(v) + 1), F.lit(MAX_OCTAVES)) * PER_OCTAVE)
    return F.when(v < 0, -depth).otherwise(depth)


def _numbers(df: DataFrame, value: Column, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, v) without missing values; and w, how often a row counts, if a column says so."""
    often = [F.col(weight).cast("long").alias("w")] if weight else []
    return df.select(*keys, value.cast("double").alias("v"), *often).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def _measures(rows: DataFrame) -> list[Column]:
    often = F.sum("w") if "w" in rows.columns else F.count("*")
    return [often.alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*_measures(rows))


def values_at_ranks(rows: DataFrame, keys: list[str], ranks) -> DataFrame:
    """(keys, tag, n, v): the value at each wanted rank of each group.

    `rows` (keys, v, and w if a row counts more than once) are read once per pass, a handful of times, and have no
    missing values. `ranks` maps the Column n (values in the group) to an array
    of struct(tag, r), r counted from 1.
    """
    coarse = _counted(rows.withColumn("b", _octave_bucket(F.col("v"))), [*keys, "b"])
    whole = Window.partitionBy(*keys)
    upto = F.sum("c").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    placed = coarse.withColumn("upto", upto).withColumn("n", F.sum("c").over(whole)).withColumn("before", F.col("upto") - F.col("c"))
    wanted = F.filter(ranks(F.col("n")), lambda x: (x["r"] > F.col("before")) & (x["r"] <= F.col("upto")))
    found = placed.withColumn("want", F.explode(wanted))
    shape = [*keys, "tag", "n", "r", "c", "lo", "hi"]
    found = materialize(found.select(*keys, "want.tag", "n", (F.col("want.r") - F.col("before")).alias("r"), "c", "lo", "hi"), "ranks")
    cell = [*keys, "lo", "hi"]

    def held(cells: DataFrame) -> DataFrame:
        return rows.join(cells.select(*cell).distinct(), keys).filter(F.col("v").between(F.col("lo"), F.col("hi")))

    large = (F.col("lo") < F.col("hi")) & (F.col("c") > SLICES)
    while not (still := found.filter(large)).isEmpty():
        inside = held(still)
        piece = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (SLICES - 1))
        renamed = inside.withColumn("s", piece).withColumnsRenamed({"lo": "from", "hi": "to"})
        slices = _counted(renamed, [*keys, "from", "to", "s"])
        upto = F.sum("c").over(Window.partitionBy(*keys, "from", "to").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
        slices = slices.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
        asked = still.select(*keys, "tag", "n", "r", F.col("lo").alias("from"), F.col("hi").alias("to"))
        met = slices.join(asked, [*keys, "from", "to"]).filter((F.col("r") > F.col("before")) & (F.col("r") <= F.col("upto")))
        met = met.withColumn("r", F.col("r") - F.col("before")).select(*shape)
        found = materialize(found.filter(~large).select(*shape).unionByName(met), "ranks")
    few = found.filter("lo < hi")
    # A cell holds few values, those counted often included.
    each = F.array_repeat("v", F.col("w").cast("int")) if "w" in rows.columns else F.array("v")
    ordered = held(few).groupBy(*cell).agg(F.sort_array(F.flatten(F.collect_list(each))).alias("values"))
    picked = few.join(ordered, cell).select(*keys, "tag", "n", F.get("values", (F.col("r") - 1).cast("int")).alias("v"))
    return found.filter("lo = hi").select(*keys, "tag", "n", F.col("lo").alias("v")).unionByName(picked)


def whole_table_ranks(df: DataFrame, value: str, percents: list[float], weight: str | None = None) -> tuple[int, dict[float, float]]:
    """(n, value at each percent's nearest rank) of a numeric column; the driver holds histograms only."""
    rows = _numbers(df, F.col(value), [], weight)
    counted = _measures(rows)
    hist = sorted(map(tuple, rows.groupBy(_octave_bucket(F.col("v")).alias("b")).agg(*counted).collect()))
    n = sum(c for _, c, _, _ in hist)
    if not n:
        return 0, {}

    def locate(buckets, rank: int):
        for _, c, lo, hi in buckets:
            if rank <= c:
                return lo, hi, rank
            rank -= c
        raise ValueError("rank beyond the last bucket")

    found = {p: locate(hist, max(1, math.ceil(p / 100 * n))) for p in percents}
    while wide := sorted({(lo, hi) for lo, hi, _ in found.values() if lo < hi}):
        # Buckets are apart, so a value lies in one of them at most.
        bucket, piece = F, F
        for i, (lo, hi) in enumerate(wide):
            inside = F.col("v").between(lo, hi)
            bucket = bucket.when(inside, F.lit(i))
            piece = piece.when(inside, F.floor((F.col("v") - lo) / (hi - lo) * (SLICES - 1)))
        slices = rows.select("*", bucket.alias("i"), piece.alias("s")).filter("i IS NOT NULL").groupBy("i", "s").agg(*counted)
        cut: dict[int, list] = {}
        for i, *rest in sorted(map(tuple, slices.collect())):
            cut.setdefault(i, []).append(tuple(rest))
        found = {p: locate(cut[wide.index((lo, hi))], r) if lo < hi else (lo, hi, r) for p, (lo, hi, r) in found.items()}
    return n, {p: lo for p, (lo, _, _) in found.items()}


def nearest_rank(df: DataFrame, value: str, percents: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, tag, n, v) with v = sorted[ceil(p/100 · n) − 1] for each percent; no rows without values."""
    if not keys:
        n, found = whole_table_ranks(df, value, percents)
        return df.sparkSession.createDataFrame([(float(p), n, x) for p, x in found.items()], "tag double, n long, v double")

    def ranks(n: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(float(p)).alias("tag"), F.greatest(F.lit(1), F.ceil(F.lit(p) / 100 * n)).alias("r"))
                for p in percents
            ]
        )

    return values_at_ranks(_numbers(df, F.col(value), keys), keys, ranks)


def medians(df: DataFrame, value: Column, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, n, median) of the values in each group; the middle pair is averaged. A row counts `weight` times."""

    def middle(n: Column) -> Column:
        low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
        return F.array(
            F.struct(F.lit(0.0).alias("tag"), low.alias("r")), F.struct(F.lit(1.0).alias("tag"), high.alias("r"))
        )

    pair = values_at_ranks(_numbers(df, value, keys, weight), keys, middle)
    return pair.groupBy(*keys).agg(F.max("n").alias("n"), F.avg("v").alias("median"))
