"""Joining a large table to a table with one row per key, whatever the skew."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# A look-up table whose rows take this much, counted on the data, is safe in every executor.
BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 16
# A key above 1/HOT_SHARE of all rows counts as hot, so there are fewer than HOT_SHARE.
HOT_SHARE = 1000
SALTS = 64


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory; fixed columns count eight bytes, nested ones as their JSON text."""
    size = F.lit(ROW_OVERHEAD)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif re.match("array|map|struct", kind):
            size = size + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


def fits_broadcast(small: DataFrame) -> bool:
    """Checked on the data, not on an estimate, with one partial sum per task."""
    return (small.agg(F.sum(row_bytes(small))).first()[0] or 0) <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Add the columns of `small` (one row per key, already materialised) to `big`.

    Small enough: broadcast, so `big` is not shuffled at all. Otherwise the
    keys that hold more than a thousandth of all rows by `weight` are
    broadcast (fewer than a thousand by construction) and the remaining,
    even, keys meet through a shuffle.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), keys, how)
    return split_join(big, small, keys, weight, how)


def split_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """The path of `lookup_join` beyond the broadcast limit.

    How often a key occurs is taken from `weight`. A key that `small` lacks, however often `big` has it, meets
    nothing in the shuffled part; there adaptive execution splits its partition, as it may on the left of a join.
    """
    total = small.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * HOT_SHARE > total
    hot, cold = small.filter(is_hot), small.filter(~is_hot)
    hot_keys = F.broadcast(hot.select(*keys))
    if fits_broadcast(hot):
        hot_rows = big.join(F.broadcast(hot), keys, "inner")
    else:
        # Few keys but wide rows: spread each hot key over several tasks.
        # The salt follows from the row, so a task run again sends it the same way.
        hashable = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
        salt = F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int")
        salted = big.join(hot_keys, keys, "left_semi").withColumn("_salt", salt)
        copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot_rows = salted.join(copies, [*keys, "_salt"], "inner").drop("_salt")
    cold_rows = big.join(hot_keys, keys, "left_anti").join(cold, keys, how)
    return hot_rows.unionByName(cold_rows)
