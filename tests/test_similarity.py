"""The pivot join and the farthest points against every pair."""

import numpy as np
import pytest

from cladeworks.operators import sampling, similarity


def clustered(rng, n, width=8, groups=12):
    centres = rng.normal(0, 1, (groups, width))
    return [(int(i), [float(x) for x in centres[rng.integers(groups)] + rng.normal(0, 0.05, width)]) for i in range(n)]


def bit_sets(rng, n, groups=10):
    bases = [set(rng.choice(256, rng.integers(5, 40), replace=False).tolist()) for _ in range(groups)]
    return [(int(i), sorted(b for b in bases[rng.integers(groups)] | set(rng.choice(256, 3).tolist()) if rng.random() < 0.95)) for i in range(n)]


def pairwise(a, b, bits):
    if bits is None:
        u = lambda rows: np.array([np.zeros(8) if v is None or not np.any(v) else np.asarray(v) / np.linalg.norm(v) for _, v in rows])
        return u(a) @ u(b).T
    sets = lambda rows: [set(v or []) for _, v in rows]
    return np.array([[len(x & y) / max(len(x | y), 1) for y in sets(b)] for x in sets(a)])


def by_hand(queries, items, bits, but_itself, places=6):
    s = np.round(pairwise(queries, items, bits), places)
    out = {}
    for (q, _), row in zip(queries, s, strict=True):
        own = sorted((-v, i) for v, (i, _) in zip(row.tolist(), items, strict=True) if not (but_itself and i == q))
        if own:
            out[q] = (own[0][1], round(-own[0][0], 6))
    return out


def rows(df):
    return {r["query_id"]: (r["item_id"], round(r["similarity"], 6)) for r in df.collect()}


@pytest.mark.parametrize("bits", [None, 256])
@pytest.mark.parametrize("but_itself", [False, True])
def test_nearest_equals_every_pair(spark, bits, but_itself):
    rng = np.random.default_rng(3)
    items = (bit_sets if bits else clustered)(rng, 1500)
    items += [(5000 + i, items[7][1]) for i in range(300)] + [(6000, [] if bits else [0.0] * 8), (6001, None), (6002, [] if bits else [0.0] * 8)]  # copies, and vectors without length
    queries = items[::40] + [(9000, items[3][1]), (6000, items[-1][1]), (9001, None)]
    queries = list(dict(queries).items())
    kind = "id bigint, vector array<int>" if bits else "id bigint, vector array<double>"
    got = rows(sampling.nearest(spark.createDataFrame(queries, kind), spark.createDataFrame(items, kind).repartition(5), but_itself, bits))
    assert got == by_hand(queries, items, bits, but_itself)


@pytest.mark.parametrize("bits", [None, 256])
def test_bounds_spare_most_pairs(spark, bits, monkeypatch):
    """Among clusters, most items are never compared; a zone of copies is spread over blocks."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 100)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 20)
    rng = np.random.default_rng(4)
    items = (bit_sets if bits else clustered)(rng, 3000, groups=40) + [(9000 + i, [1, 2, 3, 4, 5] if bits else [1.0] * 8) for i in range(900)]
    kind = "id bigint, vector array<int>" if bits else "id bigint, vector array<double>"
    df = spark.createDataFrame(items, kind)
    found = similarity.nearest_with_work(df.filter("id % 50 = 0"), df, True, bits).collect()
    assert {r["query_id"]: (r["item_id"], round(r["similarity"], 6)) for r in found} == by_hand(items[::50], items, bits, True)
    share = sum(r["compared"] for r in found) / (len(found) * len(items))
    assert share < (0.6 if bits else 0.35), share


def test_no_zone_promises_less_than_it_holds():
    rng = np.random.default_rng(5)
    import pandas as pd

    for bits, data in ((None, clustered(rng, 400)), (256, bit_sets(rng, 400))):
        space = similarity.Space(bits)
        m = space.rows(pd.Series([v for _, v in data]))
        space.pivots = similarity.far_apart(m[:60], space)
        d = space.distance(space.similarity(m, space.pivots))
        cell, size = d.argmin(1), m.sum(1)
        radius = d[np.arange(len(m)), cell]
        ring = np.minimum((radius / space.reach * similarity.RINGS).astype(int), similarity.RINGS - 1)
        keys = sorted(set(zip(cell.tolist(), ring.tolist(), strict=True)))
        at = [np.flatnonzero((cell == c) & (ring == r)) for c, r in keys]
        zone = similarity.Zones(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), *[np.array([f(x) for x in at]) for f in (len, lambda x: radius[x].min(), lambda x: radius[x].max(), lambda x: size[x].min(), lambda x: size[x].max())], np.array([m[x].max(0) for x in at]), None, None)
        bound, s = space.bounds(m, zone), space.similarity(m, m)
        for z, x in enumerate(at):
            assert (bound[:, z] >= s[:, x].max(1) - 1e-9).all()


def test_nearest_of_nothing(spark):
    kind = "id bigint, vector array<double>"
    some, none = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], kind), spark.createDataFrame([], kind)
    assert rows(sampling.nearest(none, some)) == {} and rows(sampling.nearest(some, none)) == {}
    assert rows(sampling.nearest(some, some)) == {1: (1, 1.0)} and rows(sampling.nearest(some, some, True)) == {}
    silent = spark.createDataFrame([(3, [0.0, 0.0]), (2, None)], kind)
    assert rows(sampling.nearest(silent, silent, True)) == {3: (2, 0.0), 2: (3, 0.0)}


@pytest.mark.parametrize("bits", [None, 256])
@pytest.mark.parametrize("candidates", [1, 7, 1024])
def test_farthest_points_equal_the_greedy_loop(spark, bits, candidates, monkeypatch):
    monkeypatch.setattr(sampling, "CANDIDATES", candidates)
    rng = np.random.default_rng(6)
    items = (bit_sets if bits else clustered)(rng, 160) + [(500 + i, [] if bits else [0.0] * 8) for i in range(3)]
    items += [(600 + i, items[i][1]) for i in range(20)]
    df = spark.createDataFrame(items, "id bigint, vector array<int>" if bits else "id bigint, vector array<double>").repartition(3)
    got = [(r["id"], r["distance"]) for r in sampling.farthest_points(df, 25, bits=bits).orderBy("pick").collect()]
    d = np.round(1 - pairwise(items, items, bits), 6)
    ids = [i for i, _ in items]
    picked, near = [ids.index(got[0][0])], d[ids.index(got[0][0])].copy()
    while len(picked) < 25:
        at = min((k for k in range(len(ids)) if k not in picked), key=lambda k: (-near[k], ids[k]))
        assert got[len(picked)] == (ids[at], pytest.approx(near[at]))
        picked.append(at)
        near = np.minimum(near, d[at])


def test_few_points_are_all_picked(spark):
    kind = "id bigint, vector array<double>"
    df = spark.createDataFrame([(4, [1.0, 0.0]), (4, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0])], kind)
    assert {r["id"] for r in sampling.farthest_points(df, 9).collect()} == {2, 4}
    assert sampling.farthest_points(spark.createDataFrame([], kind), 9).collect() == []


def test_memory_follows_pieces_not_batches(spark):
    """A block of copies is compared once a vector, and a batch is unpacked in pieces."""
    import pandas as pd

    frame = pd.DataFrame({"id": range(1200)})
    assert [len(f) for f in similarity.pieces(iter([frame, frame.iloc[:0], frame.iloc[:3]]))] == [512, 512, 176, 3]
    items = [(i, [1, 2, 3]) for i in range(700)] + [(0, [1, 2, 3])] + [(1000 + i, [1, 2, 4]) for i in range(50)]
    df = spark.createDataFrame(items, "id bigint, vector array<int>")
    found = similarity.nearest_with_work(df.filter("id in (0, 1, 699, 1007)"), df, True, 256).collect()
    assert {r["query_id"]: r["item_id"] for r in found} == {0: 1, 1: 0, 699: 0, 1007: 1000}
    assert max(r["compared"] for r in found) <= 8
