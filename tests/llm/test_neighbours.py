import numpy as np

from tidelog.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "s") for i, v in rows], "vec_id long, embedding array<float>, key int, list string")


def by_hand(rows, asked, k=10):
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in asked:
        if q in ok:
            near = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, asked, **options):
    t = table(spark, rows)
    return sorted(map(tuple, neighbours.nearest_neighbours(t, t.filter(t.vec_id.isin(asked)), **options).collect()))


def close(a, b):
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b], rtol=1e-13, atol=1e-13)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 1, 1, 1, 1]), (304, [float("inf")] * 6), (305, []), (None, [1.0] * 6), (306, [1.0])]
    asked = [0, 3, 7, 200, 205, 229, 300, 301, 302]
    close(run(spark, rows, asked), by_hand([r for r in rows if r[0] != 306], asked))


def test_fewer_candidates_than_asked_for(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    close(run(spark, rows, [0, 2]), by_hand(rows, [0, 2]))
    assert run(spark, [(0, [1.0])], [0]) == [] and run(spark, [], [0]) == [] and run(spark, [(1, None)], [1]) == []


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16)) * 3
    rows = [(i, (centres[i % 25] + rng.normal(size=16)).tolist()) for i in range(6000)]
    rows += [(i, rows[0][1]) for i in range(6000, 8000)]
    asked = list(range(0, 8000, 100))
    got, want = run(spark, rows, asked, list_length=40), by_hand(rows, asked)
    assert len(got) == len(want) == 10 * len(asked)
    found = {(r[0], r[2]) for r in got}
    assert np.mean([(r[0], r[2]) in found for r in want]) >= 0.9
    # Equal distances show the smaller ids.
    assert [r[2] for r in got if r[0] == 6100] == [0, *range(6000, 6009)]


def test_graph_search_against_all_centroids():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 8))
    index = neighbours.build_index(points, 150)
    sizes = np.bincount(neighbours.nearest(points, index.centroids), minlength=150)
    assert sizes.max() < 4 * len(points) / 150
    ids, dist = neighbours.search_graph(index, points[:300], 12)
    true = np.sort(neighbours.distances(points[:300], index.centroids), axis=1)[:, :12]
    assert (np.diff(dist, axis=1) >= 0).all() and np.mean(np.abs(dist - true) < 1e-9) > 0.95
    assert all(len(set(r)) == 12 for r in ids)


def test_recall_without_clusters(spark):
    """Vectors without any structure, the hardest case: the number of lists read follows from the sample."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 32)))]
    asked = list(range(0, 6000, 100))
    got, want = run(spark, rows, asked, list_length=40), by_hand(rows, asked)
    found = {(r[0], r[2]) for r in got}
    assert np.mean([(r[0], r[2]) in found for r in want]) >= 0.9


def test_small_groups_far_from_the_rest(spark):
    """Groups of near copies, and single vectors, that have a list of their own and less in it than is asked for."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 8)))]
    asked = []
    for g, size in enumerate([1, 2, 3, 5, 8, 1, 3]):
        far = rng.normal(size=8)
        far *= 60 / np.linalg.norm(far)
        asked.append(len(rows))
        rows += [(len(rows) + j, (far + 0.001 * rng.normal(size=8)).tolist()) for j in range(size)]
    for probes in (16, 1):
        got, want = run(spark, rows, asked, list_length=40, probes=probes, recall=0.5 if probes == 1 else 0.95), by_hand(rows, asked)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        found = {(r[0], r[2]) for r in got}
        assert np.mean([(r[0], r[2]) in found for r in want]) >= (0.9 if probes == 16 else 0.3)


def test_recall_is_judged_with_pruning():
    """Queries on their centroid: every list but the nearest is beyond any ratio, yet holds neighbours."""
    rng = np.random.default_rng(7)
    points = np.repeat(rng.normal(size=(300, 8)), 3, axis=0) + 1e-9 * rng.normal(size=(900, 8))
    index = neighbours.build_index(points, 220)
    reach = neighbours.reach_needed(index, points, 10, 0.95, 16, 4, 0.6)
    dist = neighbours.distances(points, index.centroids)
    ids = np.argsort(dist, axis=1, kind="stable")
    read = reach.lists_read(ids, np.take_along_axis(dist, ids, 1))
    assert read.min() >= 4 and (np.cumsum(reach.sizes[ids], 1)[np.arange(900), read - 1] >= 11).all()
    near = np.argsort(neighbours.distances(points, points), axis=1, kind="stable")[:, 1:11]
    place = np.argsort(ids, axis=1)[np.arange(900)[:, None], neighbours.nearest(points, index.centroids)[near]]
    assert (place < read[:, None]).mean() >= 0.93
