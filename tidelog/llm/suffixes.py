"""Suffix arrays by doubled ranks or induced sorting, and their permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Below this many suffixes per symbol, buckets are too short to be worth a pass each; ranks are doubled instead.
SUFFIXES_PER_SYMBOL = 24
#: Doubling ranks is faster than induction unless repeats are longer than so many symbols.
LONG_REPEAT = 1024


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last symbol is the only smallest."""
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    # Equal neighbours are of the kind of the first unequal pair after them.
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[at] > 0, True)


def _dealt(symbols: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes grouped by symbol, their order kept: symbol of each group, its size, place within the group, suffixes."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    sizes = np.diff(np.append(first, len(symbols)))
    return symbols[first].astype(np.int64), sizes, np.arange(len(symbols)) - np.repeat(first, sizes), suffixes[order]


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order.

    Buckets are passed once upwards, which places each larger suffix after the one that follows it, and once
    downwards for the smaller ones. What a bucket places is dealt out at once; suffixes placed into the bucket at
    hand, as runs of one symbol do, make a further turn.
    """
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(len(text), -1, np.int64)
    groups, lengths, _, held = _dealt(text[leftmost], leftmost)
    seeds = dict(zip(groups.tolist(), np.split(held, np.cumsum(lengths)[:-1])))
    heads, tails = starts.copy(), ends.copy()

    def place(found: np.ndarray, kind: bool, edge: np.ndarray, way: int) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            symbol, count, within, suffixes = _dealt(text[before], before)
            base = np.repeat(edge[symbol], count)
            out[base + within if way > 0 else base - 1 - within] = suffixes
            edge[symbol] += way * count

    used = np.flatnonzero(sizes).tolist()
    for c in used:
        at = int(starts[c])
        while at < (upto := int(heads[c])):
            found, at = out[at:upto], upto
            place(found, False, heads, 1)
        if c in seeds:
            place(seeds[c], False, heads, 1)
    for c in reversed(used):
        at = int(ends[c])
        while (downto := int(tails[c])) < at:
            found, at = out[downto:at][::-1], downto
            place(found, True, tails, -1)
        place(out[starts[c] : heads[c]][::-1], True, tails, -1)
        if c == used[0]:
            out[starts[c]] = len(text) - 1  # the last symbol follows no suffix that could place it
    return out


def doubled(text: np.ndarray, longest: int | None = None) -> np.ndarray | None:
    """All suffixes in order, by ranks of prefixes that double in length; only ties are sorted again.

    The first prefixes are as many symbols as fit into one number. None if suffixes agree in more than `longest` symbols.
    """
    rank = text.astype(np.int64)
    bits = max(int(rank.max()).bit_length(), 1)
    span, n = 1, len(text)
    while (more := min(span, 63 // bits - span)) > 0:
        # Past the end stand zeros. No two suffixes agree up to there, as the last symbol stands nowhere else.
        after = np.append(rank[span:], np.zeros(min(span, n), np.int64))
        rank = (rank << (more * bits)) | (after >> ((span - more) * bits))
        span += more
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
    # A rank is the place where its group begins.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        if longest is not None and span > longest:
            return None
        suffixes = order[tied]
        own = rank[suffixes]
        after = np.where(suffixes + span < n, rank[np.minimum(suffixes + span, n - 1)] + 1, 0)
        # Groups stand in order already; one number holds both ranks.
        both = own * (n + 1) + after
        sub = np.argsort(both, kind="stable")
        suffixes, both = suffixes[sub], both[sub]
        order[tied] = suffixes
        first = np.append(True, both[1:] != both[:-1])
        rank[suffixes] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~(first & np.append(first[1:], True))]
        span *= 2
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` in order; symbols are small non-negative integers, the last one smaller than all others."""
    n = len(text)
    if n < 3 or n < SUFFIXES_PER_SYMBOL * (int(text.max()) + 1) or n < 2000:
        return doubled(text)
    order = doubled(text, LONG_REPEAT)
    if order is not None:
        return order
    if text.max() < 1 << 16:
        text = text.astype(np.uint16)  # these are dealt out in linear time
    smaller = classify(text)
    is_leftmost = np.append(False, smaller[1:] & ~smaller[:-1])
    leftmost = np.flatnonzero(is_leftmost)
    # From leftmost-smaller suffixes in any order, induction yields them ordered by the substring up to the next one.
    by_substring = induce(text, smaller, leftmost)
    by_substring = by_substring[is_leftmost[by_substring]]
    names = name_substrings(text, leftmost, by_substring)
    if names.max() + 1 < len(leftmost):
        ordered = leftmost[suffix_array(names)]
    else:
        ordered = by_substring
    return induce(text, smaller, ordered)


def name_substrings(text: np.ndarray, leftmost: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """A number per leftmost-smaller substring, in text order: equal for equal ones and growing with their order."""
    number = np.zeros(len(text), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    length = np.diff(np.append(leftmost, len(text) - 1)) + 1
    at = number[by_substring]
    same = length[at][1:] == length[at][:-1]
    pairs = np.flatnonzero(same)
    offset = 0
    while len(pairs):
        pairs = pairs[length[at[pairs]] > offset]
        differ = text[by_substring[pairs] + offset] != text[by_substring[pairs + 1] + offset]
        same[pairs[differ]] = False
        pairs = pairs[~differ]
        offset += 1
    names = np.empty(len(leftmost), np.int64)
    names[at] = np.cumsum(np.append(0, ~same))
    return names


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, how many symbols it shares with the one before it in suffix order.

    Where the symbols before both suffixes are equal, the value is the previous one less one. Only the others are
    compared, and all together those comparisons stay short.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0) & (text[at - 1] == text[np.maximum(before, 1) - 1])
    start = np.flatnonzero(~reducible)
    shared = np.zeros(n, np.int64)
    a, b = start, before[start]
    alive = np.flatnonzero(b >= 0)
    a, b, offset = a[alive], b[alive], 0
    while len(a):
        inside = np.maximum(a, b) + offset < n
        a, b = a[inside], b[inside]
        same = text[a + offset] == text[b + offset]
        a, b = a[same], b[same]
        offset += 1
        shared[a] = offset
    # A reducible value counts down from the last compared one.
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(shared[source] - (at - source), 0)
