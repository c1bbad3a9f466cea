import numpy as np
import pytest

from tidelog.llm import embedding_dups


def table(spark, rows):
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "k", "g", b"u", 2) for i, v, label in rows]
    return spark.createDataFrame(plain, "vec_id long, embedding array<float>, label int, node int, key string, grp string, unit binary, n int")


def by_hand(rows, least):
    n = len(rows)
    ok = [None if v is None or label is None or not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v, np.float32).astype(float) for _, v, label in rows]
    links, group = [0] * n, list(range(n))
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= least:
                    links[a] += 1
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = [new if g == old else g for g in group]
    low = {g: min((rows[x][0] for x in range(n) if group[x] == g and rows[x][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[x][0], links[x], low[group[x]], rows[x][0] == low[group[x]]) for x in range(n)), key=repr)


def run(spark, rows, **options):
    found = embedding_dups.near_copies(table(spark, rows), **options)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, found.collect()), key=repr)


def spread(seed, n=260, dim=8, labels=3):
    """Groups of similar vectors on both sides of the threshold, and chains."""
    rng = np.random.default_rng(seed)
    rows, last = [], rng.normal(size=dim)
    for i in range(n):
        last = last + rng.normal(size=dim) * rng.choice([0.02, 0.08, 0.2, 3])
        rows.append((i, last.tolist(), int(rng.integers(labels))))
    return rows


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0] * 7 + [None], 1), (904, [float("nan")] * 8, 1), (905, [float("inf")] + [1.0] * 7, 1),
    (906, [1.0] * 8, None), (907, [1.0] * 8, 1), (907, [1.0] * 8, 1), (907, [-1.0] * 8, 1), (None, [1.0] * 8, 1), (None, [5.0, 1.0], 2), (None, None, None),
    (908, [2.0] * 8, 1), (909, [1.0] * 9, 1), (910, [1e-30] * 8, 1), (911, [3e38] * 8, 1), (912, [-0.0, 1.0], 2), (913, [0.0, 1.0], 2),
]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"numbers": (1,)}), (3, {"numbers": (64,), "tile_bytes": 512}), (4, {"least": 0.9, "tile_bytes": 1024})])
def test_against_all_pairs(spark, seed, options):
    rows = spread(seed) + ODD
    assert run(spark, rows, **options) == by_hand(rows, options.get("least", 0.98))


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [1.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_group_of_copies_and_similar_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, centre.tolist(), 0) for i in range(3000)]
    rows += [(i, (centre + rng.normal(size=16) * 0.01).tolist(), 0) for i in range(3000, 5000)]
    rows += [(i, rng.normal(size=16).tolist(), 0) for i in range(5000, 5200)]
    got = run(spark, rows, tile_bytes=16 * 8 * 300)
    assert all(r == (r[0], 4999, 0, r[0] == 0) for r in got if r[0] < 5000)
    assert all(r[1:] == (0, r[0], True) for r in got if r[0] >= 5000)


def test_cells_hold_all_partners_and_replicate_little_between_clusters():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32)) * 4
    points = np.vstack([centres[i % 20] + rng.normal(size=32) * 0.3 for i in range(2000)])
    units = [(p / np.linalg.norm(p)).tobytes() for p in points]
    pivots = embedding_dups.choose_pivots(["g"] * 2000, units, 0.2, 2_000_000)
    angles = embedding_dups._angles(units, pivots)
    near = angles <= angles.min(axis=1, keepdims=True) + 0.4
    assert len(pivots) >= 16 and near.sum() < 2 * len(points)
    matrix = embedding_dups._matrix(units, 32)
    a, b = np.nonzero(matrix @ matrix.T >= 0.98)
    assert near[a, angles.argmin(axis=1)[b]].all()
