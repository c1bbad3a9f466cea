import random

import numpy as np
from tests.llm.texts import docs, odd_texts

from tidelog.llm import near_dups, supermin
from tidelog.llm.components import components


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def by_hand(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    names = {}
    for x, (i, _) in enumerate(rows):
        names.setdefault(find(x), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in names.items()}
    return sorted(((i, len(sets[x]), low[find(x)]) for x, (i, _) in enumerate(rows)), key=repr)


def families(seed, n=6, members=14, length=60):
    """Copies with a few words changed: similarities on both sides of the threshold, and chains."""
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        text = [f"w{rng.randint(0, 400)}" for _ in range(length)]
        for _ in range(members):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(length)] = f"x{rng.randint(0, 50)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                text = copy
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    found = near_dups.group_near_duplicates(docs(spark, rows), **options)
    return sorted(map(tuple, found.collect()), key=repr)


def test_families_against_all_pairs(spark):
    rows = families(1) + list(enumerate(odd_texts(), 500)) + [(600, "A  b\tC"), (601, "a b c"), (601, "a b c"), (602, "a b"), (603, "A\x0cB"), (None, "a b c"), (None, "alone here")]
    assert run(spark, rows) == by_hand(rows, 3, 85)


def test_other_widths_and_thresholds(spark):
    rows = families(2, n=3, members=10)
    assert run(spark, rows, shingle=5, percent=80) == by_hand(rows, 5, 80)


def test_open_buckets_in_blocks(spark, monkeypatch):
    """With blocks of three rows nothing is lost between blocks, nor when no leader's link is there to help."""
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    rows = families(3, n=2, members=25)
    assert run(spark, rows) == by_hand(rows, 3, 85)


def test_empty_table_and_one_row(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, "a b c d")]) == [(4, 2, 4)]


def test_one_document_of_each_group_stays(spark):
    rows = families(4, n=2, members=8) + [(900, None), (901, None)]
    table = docs(spark, rows)
    out = near_dups.keep_one(table)
    assert out.dtypes == table.dtypes
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _, c in by_hand(rows, 5, 80) if i == c)


def test_one_row_of_each_group_stays(spark):
    same, other, lone = (" ".join(f"{c}{i}" for i in range(30)) for c in "sol")
    rows = [(None, same), (None, same), (9, other), (9, other), (7, other), (7, lone), (None, None), (None, "")]
    table = docs(spark, rows)
    out = near_dups.keep_one(table)
    assert out.dtypes == table.dtypes
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert kept == sorted([(None, same), (7, other), (7, lone), (None, None), (None, "")], key=repr)
    named = docs(spark, [(None, same), (5, same), (None, same)])
    assert [r["doc_id"] for r in near_dups.keep_one(named).collect()] == [5]
    assert near_dups.keep_one(docs(spark, [])).collect() == []


def test_signature_of_a_long_set_in_blocks(monkeypatch):
    elements = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    whole = supermin.signatures([elements], 128)
    monkeypatch.setattr(supermin, "BLOCK", 128 * 300)
    assert (supermin.signatures([elements], 128) == whole).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    bands, rows = supermin.banding(85)
    for share in (0.5, 0.85, 0.95):
        gaps = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            rest = rng.integers(0, 2**63, 400 - len(both), dtype=np.uint64)
            half = len(rest) // 2
            a, b = np.unique(np.concatenate([both, rest[:half]])), np.unique(np.concatenate([both, rest[half:]]))
            sig = supermin.signatures([a, b], bands * rows)
            gaps.append(supermin.estimated(*supermin.brief(sig)) - share)
        assert abs(np.mean(gaps)) < 0.01
        # Lower variance than independent permutations would give.
        assert np.std(gaps) < 1.05 * (share * (1 - share) / (bands * rows)) ** 0.5


def test_signature_by_definition_for_small_sets():
    """Each element's visits are a permutation of the slots, and a slot keeps its smallest value."""
    one = supermin.signatures([np.array([7], np.uint64)], 32)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(32))
    other = supermin.signatures([np.array([9], np.uint64)], 32)[0]
    both = supermin.signatures([np.array([7, 9], np.uint64)], 32)[0]
    assert (both == np.minimum(one, other)).all()


def test_long_chains_are_one_component(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5001)]
    rng.shuffle(links)
    table = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in links], "a long, b long").repartition(8)
    got = {r["node"]: r["root"] for r in components(table).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000, 5001: 5000}
    assert components(table.limit(0)).collect() == []
