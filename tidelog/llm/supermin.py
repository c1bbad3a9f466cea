"""Word shingle sets and their SuperMinHash signatures, in numpy over chunks of documents."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Slots of a signature at most, and the probability of a pair at the threshold to share no band.
MOST_SLOTS = 170
MISS = 2e-6
#: Elements times slots worked on at once; a longer set is taken in blocks.
BLOCK = 10_000_000
#: Powers a worker keeps; longer texts compute their own.
KEPT_POWERS = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_known: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes `flat` starts, and its 64-bit hash.

    A word's hash is a polynomial in its bytes, as the difference of two prefix sums brought to the word's start.
    """
    letter = ~_SPACE[flat]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(flat) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * power[: len(flat)], dtype=np.uint64)))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if n <= len(_known[0]):
        return _known[0], _known[1]
    tables = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(max(n, KEPT_POWERS), base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _known[:] = tables
    return tables[0], tables[1]


def shingle_sets(chunk: list[str], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of all runs of `k` words; of the whole text if it has fewer words.

    Empty without words. Words are cut at space, \\t, \\n, \\v, \\f and \\r; A-Z are lower-cased.
    """
    raw = [t.encode("utf-8", "replace").lower() for t in chunk]
    starts, h = word_hashes(np.frombuffer(b" ".join(raw), np.uint8))
    cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))))
    runs = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for i in range(k):
        runs = mix(runs * _GOLD + h[i : len(h) - k + 1 + i])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            whole = np.full(min(b - a, 1), b - a, np.uint64)
            for i in range(a, b):
                whole = mix(whole * _GOLD + h[i])
            out.append(whole)
    return out


def set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows per band: as many rows as MISS and MOST_SLOTS allow at this similarity."""
    likely = min(percent, 99) / 100
    fits = [(math.ceil(math.log(MISS) / math.log(1 - likely**rows)), rows) for rows in range(1, 33)]
    return max((f for f in fits if f[0] * f[1] <= MOST_SLOTS), key=lambda f: f[1], default=(MOST_SLOTS, 1))


def least_estimate(percent: int, slots: int) -> float:
    """An estimate from `slots` slots that no pair at the threshold falls below, but for one in ten million."""
    likely = percent / 100
    return likely - 5.5 * math.sqrt(likely * (1 - likely) / slots)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash: one row of `slots` values per set; sets are not empty.

    Every element visits the slots in an order of its own. Its value in the slot it visits as number j is j plus a
    random fraction, and a slot keeps the smallest value of any element. As values of later visits are larger, a
    set is done once all its slots hold less than the next visit's number.
    """
    if len(sets) == 1 and len(sets[0]) > (step := max(1, BLOCK // slots)):
        # What an element leaves in a slot depends on no other element.
        return np.minimum.reduce([signatures([sets[0][i : i + step]], slots) for i in range(0, len(sets[0]), step)])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(flat), 1))
    best = np.full((len(sets), slots), np.uint64(2**64 - 1))
    active = np.arange(len(flat))
    for j in range(slots):
        x = mix(flat[active] + np.uint64((j + 1) * int(_GOLD) % 2**64))
        pick = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = order[active, pick]
        order[active, pick] = order[active, j]
        value = (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32))
        np.minimum.at(best.reshape(-1), owner[active] * slots + slot, value)
        settled = best.max(1) < np.uint64(j + 1) << np.uint64(32)
        active = active[~settled[owner[active]]]
        if not len(active):
            break
    return best


def band_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per set and band."""
    rows = sigs.reshape(len(sigs), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        keys = mix(keys * _GOLD + rows[:, :, i])
    return keys.view(np.int64)


def brief(sigs: np.ndarray) -> np.ndarray:
    """A byte per slot, enough to estimate a similarity from."""
    return (mix(sigs) & np.uint64(0xFF)).astype(np.uint8)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the sets behind brief signatures, without the matches of chance."""
    same = (a == b).mean(-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def chunked(sets: list[np.ndarray], slots: int, limit: int = BLOCK):
    """Index ranges of `sets` whose elements times `slots`, the scratch memory of `signatures`, are about `limit`."""
    start, held = 0, 0
    for i, s in enumerate(sets):
        if i > start and (held + len(s)) * slots > limit:
            yield start, i
            start, held = i, 0
        held += len(s)
    if start < len(sets):
        yield start, len(sets)
