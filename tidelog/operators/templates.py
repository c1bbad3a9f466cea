"""Message templates: messages of one shape that differ in a few words.

The rule is sequential: a message joins the first template of its group (same
token count, same first-token class) that agrees in half of its positions, and
turns the positions that differ into wildcards; otherwise it starts a template.

Run as written this needs one pass over each group in order. What makes it
parallel is that a template only ever gains wildcards: once it agrees with a
message it always will, once it covers one (merging would change nothing) it
always will, and almost every message changes nothing. So all that is known
of a distinct message is one template, its first agreeing one, and whether
that one covers it. Each round
  1. picks, per group, the earliest messages that would change a template,
  2. replays them in order, one small task per group, each with the template
     that takes it now; no other template can take part,
  3. looks up, in an inverted index, which distinct messages the new versions
     agree with, and checks that no message in between would have changed a
     template when it arrived; if one would, the group is wound back to it.
Every round settles at least the first open change of each group, and a
message is judged by the templates as of its own arrival, so the outcome is
that of the sequential rule. A group of which every arrival that is left was
replayed is done: nothing of it is looked up.

The index holds (group, position, token) of a version at as many of its rarest
tokens as it takes for a message that agrees to share at least one. A version
that agrees with everything by its wildcards alone is looked up by its group.
Rows of the index carry no tokens, but four bits of each token's hash: pairs
that differ in too many of them are dropped where they meet, the others get
their tokens and are compared.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import log_id
from ..functions.text import is_blank
from ..functions.tokens import (
    SIMILARITY,
    WILDCARD,
    group_key,
    join_tokens,
    token_similarity,
    tokenize,
)
from ..plans.lookup import fits_broadcast, lookup_join
from ..session import materialize

# Fixed value: templates in the report.
REPORTED = 20
# Messages per group replayed in order in the first round, and at most. A group
# that always fills its block has it doubled from round to round.
FIRST_BLOCK = 250
LAST_BLOCK = 65_536
# Parts of a group in which its earliest messages are looked for first.
PARTS = 64
# Tokens whose hash bits share one number of a sketch, and numbers of a sketch.
NIBBLES, SKETCH = 16, 3
EACH_NIBBLE = 0x1111111111111111

_CHANGES = "key string, cluster int, since_idx bigint, since_source string, tokens array<string>, probes array<int>, full boolean, tid string, done boolean"


def _at(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}idx").alias("idx"), F.col(f"{prefix}source").alias("source"))


def grouped_messages(events: DataFrame) -> DataFrame:
    """(key, tid, at, tokens): blank messages have no tokens and are left out. Equal tokens have equal `tid`."""
    return (
        events.filter(~is_blank("full_request"))
        .withColumn("tokens", tokenize("full_request"))
        .withColumn("key", group_key("tokens"))
        .withColumn("tid", F.md5(F.array_join("tokens", " ")))
        .withColumn("at", _at())
    )


def _distinct_messages(messages: DataFrame) -> DataFrame:
    """(tid, key, tokens, n, first): one row per distinct message, with its number and first arrival."""
    rows = messages.groupBy("tid").agg(F.first("key").alias("key"), F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.min("at").alias("first"))
    return materialize(rows, "distinct-messages")


def _needed(width: int, threshold: float) -> int:
    """Fewest agreeing positions out of `width` that reach the threshold."""
    return next(n for n in range(width + 2) if n / width >= threshold or n > width)


def _covers(known: Column, message: Column) -> Column:
    """Merging the message would leave the template as it is."""
    return F.forall(F.zip_with(known, message, lambda x, y: (x == y) | (x == WILDCARD)), lambda same: same)


def _per_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their group, of which `groups` has one row each."""
    return rows.join(F.broadcast(groups) if fits_broadcast(groups) else groups, "key", how)


def _packed(tokens: str, bits) -> list[Column]:
    """Four bits of each token, sixteen tokens to a number; tokens beyond the last number are left out."""

    def number(part: int) -> Column:
        placed = F.transform(F.slice(tokens, part * NIBBLES + 1, NIBBLES), lambda t, i: F.call_function("shiftleft", bits(t), i * 4))
        return F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return [number(part) for part in range(SKETCH)]


def _sketch(tokens: str) -> list[Column]:
    return _packed(tokens, lambda t: F.xxhash64(t).bitwiseAND(F.lit(15).cast("bigint")))


def _solid(tokens: str) -> list[Column]:
    return _packed(tokens, lambda t: F.when(t == WILDCARD, 0).otherwise(15).cast("bigint"))


def _differing() -> Column:
    """Places at which a message (m_0 ...) differs from what is solid (k_0 ...) in a version (v_0 ...), for certain."""
    total = F.lit(0)
    for part in range(SKETCH):
        bits = F.col(f"m_{part}").bitwiseXOR(F.col(f"v_{part}")).bitwiseAND(F.col(f"k_{part}"))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        total = total + F.bit_count(bits.bitwiseAND(F.lit(EACH_NIBBLE)))
    return total


def _agreeing(messages: DataFrame, versions: DataFrame, threshold: float) -> DataFrame:
    """Columns of both for every distinct message (tid, key, tokens) and version (key, cluster, known, probes) that agree.

    `probes` are the version's positions in the index; null if it agrees with every message of its group.
    """
    names = [*messages.columns, *[c for c in versions.columns if c != "key"]]
    since = ["since"] if "since" in versions.columns else []
    versions = versions.withColumnRenamed("key", "v_key").withColumn("v", F.xxhash64("v_key", "cluster", *since))
    messages = messages.withColumn("m", F.xxhash64("tid"))
    wild = F.array_contains("tokens", WILDCARD)
    # Where two ids or entries have one hash, the tokens still decide.
    words = messages.filter(~wild).select("m", "key", F.posexplode("tokens").alias("place", "word"), *[c.alias(f"m_{i}") for i, c in enumerate(_sketch("tokens"))])
    words = words.select(F.xxhash64("key", "place", "word").alias("entry"), "m", *[f"m_{i}" for i in range(SKETCH)])
    sketches = [c.alias(f"{name}_{i}") for name, of in (("v", _sketch), ("k", _solid)) for i, c in enumerate(of("known"))]
    index = versions.filter(F.col("probes").isNotNull()).select("v", "v_key", "known", F.size("known").alias("width"), F.explode("probes").alias("place"), *sketches)
    index = index.withColumn("entry", F.xxhash64("v_key", "place", F.get("known", F.col("place")))).drop("v_key", "known", "place")
    likely = words.join(index, "entry").filter((F.col("width") - _differing()) / F.col("width") >= threshold).select("m", "v").distinct()
    same_group = F.col("key") == F.col("v_key")
    met = likely.join(versions, "v").join(messages.filter(~wild), "m").filter(same_group).select(*names)
    all_of_group = messages.filter(~wild).join(versions.filter(F.col("probes").isNull()), same_group).select(*names)
    # A wildcard in a message's own text agrees with any token.
    odd = messages.filter(wild).join(versions, same_group).select(*names)
    pairs = met.unionByName(all_of_group).unionByName(odd)
    return pairs.filter(token_similarity("known", "tokens") >= threshold)


def _probes(tokens: list[str], width: int, need: int, count) -> list[int] | None:
    """Places of the rarest tokens, as many as a message that agrees can't all miss."""
    solid = [i for i, t in enumerate(tokens) if t != WILDCARD]
    if width - len(solid) >= need:
        return None
    return sorted(solid, key=lambda i: (count[i][tokens[i]], -i))[: width - need + 1]


def _replay(threshold: float, block: int):
    """Sequential rule over at most `block` messages of one group and the templates that take them now."""

    def run(messages: pd.DataFrame) -> pd.DataFrame:
        key, start = messages["key"].iloc[0], int(messages["next"].iloc[0])
        codes: dict[str, int] = {WILDCARD: 0}
        words = [WILDCARD]

        def encode(tokens) -> np.ndarray:
            for token in tokens:
                if token not in codes:
                    codes[token] = len(words)
                    words.append(token)
            return np.array([codes[t] for t in tokens], dtype=np.int64)

        messages = messages.sort_values(["idx", "source"], kind="stable")
        width = len(messages["tokens"].iloc[0])
        need = _needed(width, threshold)
        count = [Counter(column) for column in zip(*messages["tokens"])]
        taking = messages[messages["base"].notna()].drop_duplicates("base").sort_values("base")
        names = [int(c) for c in taking["base"]]
        table = np.zeros((max(64, 2 * len(names)), width), dtype=np.int64)
        # The same index as between the groups' messages and versions, for the rows of `table`.
        posted: dict[tuple[int, str], list[int]] = {}
        open_to_all: list[int] = []

        def post(row: int, tokens: list[str]) -> list[int] | None:
            probes = _probes(tokens, width, need, count)
            if probes is None:
                open_to_all.append(row)
            for p in probes or []:
                posted.setdefault((p, tokens[p]), []).append(row)
            return probes

        for row, tokens in enumerate(taking["known"]):
            table[row] = encode(tokens)
            post(row, list(tokens))
        changes, takers = [], []
        for idx, source, tokens, tid in zip(messages["idx"], messages["source"], messages["tokens"], messages["tid"]):
            message = encode(tokens)
            if 0 in message:
                rows = np.arange(len(names))
            else:
                rows = np.array(sorted({*open_to_all, *(r for at in enumerate(tokens) for r in posted.get(at, ()))}), dtype=np.int64)
            known = table[rows]
            hits = np.flatnonzero(((known == message) | (known == 0) | (message == 0)).sum(axis=1) >= need)
            if len(hits):
                row = int(rows[hits[0]])
                takers.append((key, names[row], int(idx), source, None, None, False, tid, False))
                merged = np.where(table[row] == message, table[row], 0)
                if (merged == table[row]).all():
                    continue
            else:
                row, merged = len(names), message
                names.append(start)
                takers.append((key, start, int(idx), source, None, None, False, tid, False))
                start += 1
                if row >= len(table):
                    table = np.vstack([table, np.zeros_like(table)])
            table[row] = merged
            now = [words[c] for c in merged]
            changes.append((key, names[row], int(idx), source, now, post(row, now), False, None, False))
        # A full block may be followed by more; its last message marks how far it reached.
        last = messages.iloc[-1]
        done = int(messages["left"].iloc[0]) == len(messages)
        changes.append((key, -1, int(last["idx"]), last["source"], [], None, len(messages) >= block, None, done))
        if done:
            changes += takers
        return pd.DataFrame(changes, columns=[c.split()[0] for c in _CHANGES.split(", ")])

    return run


def _earliest(df: DataFrame, block: int) -> DataFrame:
    """The `block` rows of each group that arrive first, found within parts of it before."""
    for by in (["key", "part"], ["key"]):
        order = Window.partitionBy(*by).orderBy("arrival")
        df = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= block)
    return df.drop("rank")


def learn_templates(events: DataFrame, threshold: float = SIMILARITY, first_block: int = FIRST_BLOCK) -> DataFrame:
    """(key, cluster, since, tokens, probes): every version every template went through.

    `since` is the arrival (idx, source) of the message that made the version.
    """
    messages = materialize(grouped_messages(events).select("tid", "key", "at", "tokens"), "messages")
    return _learn(messages, _distinct_messages(messages), threshold, first_block)[0]


def _learn(messages: DataFrame, distinct: DataFrame, threshold: float, first_block: int) -> tuple[DataFrame, DataFrame]:
    """Every version, and (tid, cluster, since): from when on a template takes a message, unless one before it does."""
    # base: the template that takes the message now; settled: it covers it; open_from: null is the beginning.
    state = distinct.select(
        "tid", "key", "tokens", "n", "first", F.lit(None).cast("int").alias("base"), F.lit(False).alias("settled"),
        F.lit(None).cast(messages.schema["at"].dataType).alias("open_from"), F.lit(0).alias("next"),
    )
    arrivals = messages.select("tid", "at")
    log: DataFrame | None = None
    taken: list[DataFrame] = []
    block = max(1, min(first_block, LAST_BLOCK))
    while True:
        changing = state.filter(~F.col("settled"))
        if log is None:
            upcoming = changing.withColumn("arrival", F.col("first"))
        else:
            later = arrivals.join(changing.select("tid", "open_from"), "tid").filter(F.col("open_from").isNull() | (F.col("at") >= F.col("open_from")))
            upcoming = changing.join(later.groupBy("tid").agg(F.min("at").alias("arrival")), "tid")
        # Arrivals left in a group; one whose messages come again has more than any block.
        to_come = F.when(F.col("n") > 1, F.lit(LAST_BLOCK + 1)).when(F.col("open_from").isNull() | (F.col("first") >= F.col("open_from")), 1).otherwise(0)
        left = state.groupBy("key").agg(F.sum(to_come).alias("left"))
        upcoming = upcoming.select("tid", "key", "tokens", "base", "next", "arrival", F.pmod(F.xxhash64("tid"), F.lit(PARTS)).alias("part"))
        chosen = _earliest(upcoming, block).select("tid", "key", "arrival.idx", "arrival.source", "tokens", "base", "next")
        chosen = _per_group(chosen, left)
        if log is None:
            chosen = chosen.withColumn("known", F.lit(None).cast("array<string>"))
        else:
            latest = log.groupBy("key", F.col("cluster").alias("base")).agg(F.max_by("tokens", "since").alias("known"))
            chosen = chosen.join(latest, ["key", "base"], "left")
        replayed = chosen.groupBy("key").applyInPandas(_replay(threshold, block), _CHANGES)
        replayed = materialize(replayed.withColumn("since", _at("since_")), "replayed")
        made = replayed.filter((F.col("cluster") >= 0) & F.col("tid").isNull()).select("key", "cluster", "since", F.col("tokens").alias("known"), "probes")
        taken.append(replayed.filter(F.col("tid").isNotNull()).select("tid", "cluster", "since"))
        ended = replayed.filter("done").select("key")
        ended = F.broadcast(ended) if fits_broadcast(ended) else ended
        reach = replayed.filter((F.col("cluster") < 0) & ~F.col("done")).select("key", F.when(F.col("full"), F.col("since")).alias("reach"))
        state = _per_group(state, reach)

        # From when on a template touched in this round agrees with a message, and from when on it covers it.
        open_made = made.join(ended, "key", "left_anti")
        pairs = _agreeing(state.select("tid", "key", "tokens", "base"), open_made, threshold).filter(F.col("base").isNull() | (F.col("cluster") <= F.col("base")))
        since = F.col("since")
        met = pairs.groupBy("tid", "cluster").agg(F.min(since).alias("agrees"), F.min(F.when(_covers(F.col("known"), F.col("tokens")), since)).alias("covers"))
        entries = met.groupBy("tid").agg(F.collect_list(F.struct("cluster", "agrees", "covers")).alias("entries"))
        seen = state.join(entries, "tid", "left")
        seen = materialize(seen.withColumn("entries", F.coalesce("entries", F.array())), "seen")

        # Who takes a message that arrives at `at`: the first template that agrees by then.
        at = F.col("at")
        taking = F.array_min(
            F.transform(
                F.filter("entries", lambda e: e["agrees"] <= at),
                lambda e: F.struct(e["cluster"], (e["covers"].isNotNull() & (e["covers"] <= at)).alias("covered")),
            )
        )
        base = F.col("base")
        by_base = base.isNotNull() & (taking.isNull() | (base < taking["cluster"]))
        covered = F.when(by_base | (base == taking["cluster"]) & F.col("settled"), F.col("settled")).otherwise(F.coalesce(taking["covered"], F.lit(False)))
        doubtful = seen.filter(~F.col("settled") | F.exists("entries", lambda e: base.isNull() | (e["cluster"] < base)))
        between = arrivals.join(doubtful.select("tid", "key", "base", "settled", "entries", "open_from", "reach"), "tid")
        between = between.filter((F.col("open_from").isNull() | (at >= F.col("open_from"))) & (F.col("reach").isNull() | (at <= F.col("reach"))))
        missed = materialize(between.filter(~covered).groupBy("key").agg(F.min("at").alias("missed")), "missed")

        valid = _per_group(made, missed, "left").filter(F.col("missed").isNull() | (since < F.col("missed")))
        valid = valid.select("key", "cluster", "since", F.col("known").alias("tokens"), "probes")
        log = materialize(valid if log is None else log.unionByName(valid), "log")
        judged = _per_group(seen, missed, "left")
        still_open = judged.withColumn("open_from", F.coalesce("missed", "reach")).filter(F.col("open_from").isNotNull())
        counted = log.groupBy("key").agg((F.max("cluster") + 1).alias("next"))
        kept = F.filter("entries", lambda e: F.col("missed").isNull() | (e["agrees"] < F.col("missed")))
        took = judged.select("tid", F.explode(kept).alias("entry")).select("tid", "entry.cluster", F.col("entry.agrees").alias("since"))
        taken.append(materialize(took, "taken"))
        least = F.array_min(F.transform(kept, lambda e: F.struct(e["cluster"], (e["covers"].isNotNull() & (F.col("missed").isNull() | (e["covers"] < F.col("missed")))).alias("covered"))))
        lower = least.isNotNull() & (base.isNull() | (least["cluster"] < base))
        same = least.isNotNull() & (least["cluster"] == base)
        state = _per_group(still_open.drop("next"), counted).select(
            "tid", "key", "tokens", "n", "first",
            F.when(lower, least["cluster"]).otherwise(base).alias("base"),
            F.when(lower, least["covered"]).when(same, F.col("settled") | least["covered"]).otherwise(F.col("settled")).alias("settled"),
            "open_from", "next",
        )
        state = materialize(state, "state")
        # Without a message that its template does not cover, nothing can change any more.
        if state.filter(~F.col("settled")).isEmpty():
            return log, reduce(DataFrame.unionByName, taken)
        block = min(block * 2, LAST_BLOCK)


def _with_probes(versions: DataFrame, threshold: float) -> DataFrame:
    """Index places for versions (key, cluster, known) that come without: those of the tokens rarest among them."""
    width = F.size("known")
    need = F.ceil(F.round(width * F.lit(threshold), 9)).cast("int")
    each = versions.select("key", "cluster", "known", F.posexplode("known").alias("place", "token")).filter(F.col("token") != WILDCARD)
    often = each.groupBy("key", "place", "token").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["key", "place", "token"]).groupBy("key", "cluster").agg(F.sort_array(F.collect_list(F.struct("often", (-F.col("place")).alias("back")))).alias("ranked"))
    solid = F.size(F.filter("known", lambda t: t != WILDCARD))
    places = F.transform(F.slice("ranked", 1, width - need + 1), lambda r: -r["back"])
    return versions.join(ranked, ["key", "cluster"], "left").withColumn("probes", F.when(width - solid < need, places)).drop("ranked")


def cluster_assignments(events: DataFrame, log: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Events with (key, cluster): the template each message joined when it arrived."""
    messages = grouped_messages(events)
    distinct = _distinct_messages(messages)
    pairs = _agreeing(distinct.select("tid", "key", "tokens"), log.withColumnRenamed("tokens", "known"), threshold)
    return _assigned(messages, distinct, pairs.select("tid", "cluster", "since")).drop("tokens", "tid")


def _assigned(messages: DataFrame, distinct: DataFrame, agreed: DataFrame) -> DataFrame:
    """Messages with the template that takes each, given (tid, cluster, since): from when on a template agrees."""
    met = agreed.groupBy("tid", "cluster").agg(F.min("since").alias("since"))
    # A template takes over from when it agrees if it stands before the one so far.
    so_far = F.min("cluster").over(Window.partitionBy("tid").orderBy("since").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    took = met.withColumn("so_far", so_far).filter(F.col("cluster") == F.col("so_far"))
    took = took.withColumn("until", F.lead("since").over(Window.partitionBy("tid").orderBy("since")))
    steps = F.sort_array(F.collect_list(F.struct("since", "until", "cluster")))
    takers = took.groupBy("tid").agg(steps.alias("takers")).join(distinct.select("tid", "n"), "tid")
    takers = materialize(takers, "takers")
    joined = lookup_join(messages, takers, ["tid"], weight="n")
    at = F.col("at")
    hit = F.get(F.filter("takers", lambda t: (t["since"] <= at) & (t["until"].isNull() | (at < t["until"]))), F.lit(0))
    return joined.withColumn("cluster", hit["cluster"]).drop("takers", "n")


def cluster_severity() -> Column:
    """CRITICAL if any record is; ERROR if the first is INFO and any is ERROR; else the first one's."""
    first = F.min_by("severity", "at")
    return (
        F.when(F.max(F.col("severity") == "CRITICAL"), "CRITICAL")
        .when((first == "INFO") & F.max(F.col("severity") == "ERROR"), "ERROR")
        .otherwise(first)
    )


def all_templates(events: DataFrame, threshold: float = SIMILARITY, first_block: int = FIRST_BLOCK) -> DataFrame:
    """Every template with its statistics and its place in the order of discovery."""
    messages = grouped_messages(events).select("tid", "key", "at", "tokens", "full_request", "is_error", "latency", "severity")
    messages = materialize(messages, "messages")
    distinct = _distinct_messages(messages)
    log, agreed = _learn(messages, distinct, threshold, first_block)
    final = log.groupBy("key", "cluster").agg(F.max_by("tokens", "since").alias("tokens"))
    group_seen = log.groupBy("key").agg(F.min("since").alias("group_seen"))
    statistics = _assigned(messages.drop("tokens"), distinct, agreed).groupBy("key", "cluster").agg(
        F.min_by("full_request", "at").alias("sample"),
        F.count("*").alias("count"),
        F.count_if("is_error").alias("error_count"),
        F.avg("latency").alias("avg_latency"),
        cluster_severity().alias("severity"),
    )
    template = join_tokens("tokens")
    return (
        statistics.join(final, ["key", "cluster"])
        .join(group_seen, "key")
        .withColumn("template", template)
        .withColumn("id", log_id(F.col("template"), F.lit(0)))
    )


def cluster_logs(
    events: DataFrame, k: int = REPORTED, threshold: float = SIMILARITY, first_block: int = FIRST_BLOCK
) -> DataFrame:
    """The k most frequent templates; ties keep the order of discovery."""
    top = all_templates(events, threshold, first_block).orderBy(F.desc("count"), "group_seen", "cluster").limit(k)
    return top.select(
        "id", "template", "sample", "count", "error_count", "avg_latency", "severity", "key", "cluster", "tokens"
    )


def assign_templates(events: DataFrame, templates: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Events with `cluster_id`: the first of the given finished templates that agrees, or null.

    `templates` must be a table that has been written. The first match is found once per distinct message.
    """
    taken = [c for c in ("tokens", "key", "tid", "at") if c in events.columns]
    names = {c: f"_{c}" for c in taken}
    messages = grouped_messages(events.withColumnsRenamed(names))
    distinct = _distinct_messages(messages)
    versions = _with_probes(templates.select("key", "cluster", "id", F.col("tokens").alias("known")), threshold)
    met = _agreeing(distinct.select("tid", "key", "tokens", "n"), versions.withColumnRenamed("id", "cluster_id"), threshold)
    first = materialize(met.groupBy("tid", "n").agg(F.min_by("cluster_id", "cluster").alias("cluster_id")), "first-matches")
    rows = events.withColumn("_tid", F.md5(F.array_join(tokenize("full_request"), " ")))
    return lookup_join(rows, first.withColumnRenamed("tid", "_tid"), ["_tid"], weight="n", how="left").drop("_tid", "n")
