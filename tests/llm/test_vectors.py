"""Centroid clusters and near copies of vectors against brute force."""

import hashlib
import random

import numpy as np
import pytest

from faultline.llm import caps, centroids

VECTORS = "vec_id long, embedding array<float>, label int, row string, v int, cluster int, node string"


def _row(i, vector, label=0):
    return (i, None if vector is None else [None if x is None else float(np.float32(x)) for x in vector], label, "r", 1, 2, "n")


def _odd(rng):
    """Vectors null, empty, too short, too long, zero, with null or non-finite components, equal, with repeated and null ids."""
    base = rng.standard_normal(64)
    near = base + rng.standard_normal(64) * 0.02
    return [
        _row(1, None), _row(2, []), _row(3, base[:63]), _row(4, [*base, 1.0]), _row(5, np.zeros(64)), _row(6, [*base[:63], None]),
        _row(7, [*base[:63], float("nan")]), _row(8, [*base[:63], float("inf")]), _row(9, base), _row(9, base), _row(10, near), _row(None, near),
        _row(11, base, 1), _row(12, base, None), _row(13, -base), _row(14, base * 3), _row(10, -base, 1), _row(15, base[:63]),
        *(_row(20 + k, rng.standard_normal(64), k % 2) for k in range(30)),
    ]


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    middle = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(middle)):
            members = [v for (_, v), n in zip(kept, own, strict=True) if n == c]
            if members:
                middle[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, c in found:
        sums[c] = sums.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, d, c in found), key=str)


def test_lists_find_the_nearest_centroid():
    rng = np.random.default_rng(1)
    for k, dims, spread in [(1, 3, 5), (8, 2, 3), (8, 64, 1000), (50, 1, 4), (200, 6, 1 << 26)]:
        middle = rng.integers(-spread, spread, (k, dims))
        vectors = rng.integers(-spread, spread, (300, dims))
        number, distance, reckoned = centroids.Lists(middle).nearest(vectors)
        every = ((vectors[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and reckoned <= every.size
    # In few dimensions the walk ends long before all centroids are reckoned.
    middle = rng.integers(0, 10**6, (200, 2))
    assert centroids.Lists(middle).nearest(middle + 3)[2] < 200 * 200 / 4


def test_clusters_of_odd_vectors(spark):
    rows = _odd(np.random.default_rng(2))
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted((tuple(r) for r in centroids.report(df).collect()), key=str) == plain_clusters([r[:2] for r in rows])
    assert centroids.report(df.limit(0)).count() == 0
    few = df.filter("vec_id in (9, 10)")
    assert sorted((tuple(r) for r in centroids.report(few).collect()), key=str) == plain_clusters([r[:2] for r in rows if r[0] in (9, 10)])


def test_clusters_do_not_follow_the_file_layout(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = sorted(map(tuple, centroids.report(vectors.coalesce(1)).collect()))
    assert one == sorted(map(tuple, centroids.report(vectors.repartition(7)).collect()))


def test_components_beyond_the_bound_fail(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.report(spark.createDataFrame([_row(1, [1e9] * 64)], VECTORS)).collect()


def plain_links(rows, threshold=caps.THRESHOLD):
    good = {
        n: np.array(v, dtype=float) for n, (_, v, label) in enumerate(rows)
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    ties = {n: set() for n in range(len(rows))}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                ties[a].add(b)
    out = []
    for n, (i, *_) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in ties[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        root = min(ids) if ids else None
        out.append((i, len(ties[n]), root, i == root))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_copies_of_odd_vectors(spark):
    rows = _odd(np.random.default_rng(2))
    df = spark.createDataFrame(rows, VECTORS)
    assert _found(caps.near_copies(df)) == plain_links([r[:3] for r in rows])
    assert caps.near_copies(df.limit(0)).count() == 0
    assert _found(caps.near_copies(df.filter("vec_id <= 2"))) == plain_links([r[:3] for r in rows if r[0] in (1, 2)])


def _planted(rng, groups, size, noise, dims=64):
    """Chains and clouds of near vectors among random ones."""
    rows = [(rng.standard_normal(dims), k % 3) for k in range(200)]
    for g in range(groups):
        at = rng.standard_normal(dims)
        for _ in range(size):
            rows.append((at + rng.standard_normal(dims) * noise, g % 3))
            at = at + rng.standard_normal(dims) * noise * (g % 2)
    return [_row(100 + n, v, label) for n, (v, label) in enumerate(rows)]


def test_links_equal_all_pairs(spark, monkeypatch):
    """Clouds, chains and a group of many copies, whole and cut into tiles."""
    rows = _planted(np.random.default_rng(5), 12, 25, 0.15)
    rows += [(1000 + k, *rows[250][1:]) for k in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    wanted = plain_links([r[:3] for r in rows])
    assert sum(w[1] for w in wanted) > 2000
    assert _found(caps.near_copies(df)) == wanted
    monkeypatch.setattr(caps, "BLOCK", 7)
    assert _found(caps.near_copies(df.repartition(5))) == wanted


@pytest.mark.parametrize(("members", "least"), [(500, 0.9985), (100_000, 0.9985), (10**9, 0.98)])
def test_recall_at_the_threshold(members, least):
    """Pairs at cosine 0.93 sharp meet in a filter, for plans of small and large tables."""
    rng = np.random.default_rng(6)
    n, dims = 2000 if members < 10**6 else 300, 64
    code = caps.Code(caps.plan(members, dims, caps.THRESHOLD))
    u = rng.standard_normal((n, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = rng.standard_normal((n, dims))
    g -= (g * u).sum(axis=1, keepdims=True) * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    lists = [[set() for _ in range(n)] for _ in range(2)]
    for own, vectors in zip(lists, (u, v), strict=True):
        row, direction = code.decode(vectors)
        for a, b in zip(row.tolist(), direction.tolist(), strict=True):
            own[a].add(b)
    shared = [len(a & b) for a, b in zip(*lists, strict=True)]
    assert np.mean([s > 0 for s in shared]) >= least
    # The lists do not grow with the table.
    assert np.mean([len(a) for a in lists[0]]) < 120


def test_decoding_finds_all_directions_beyond_the_cap():
    rng = np.random.default_rng(7)
    code = caps.Code(caps.plan(2000, 16, 0.9))
    vectors = rng.standard_normal((50, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    row, direction = code.decode(vectors)
    every = code.directions()
    assert np.abs(np.linalg.norm(every, axis=1) - 1).max() < 1e-3
    passed = np.zeros((50, len(every)), dtype=bool)
    passed[row, direction] = True
    dots = vectors @ every.T
    # Vectors and codewords are rounded before they meet.
    sure = np.abs(dots - code.alpha) > 1e-3
    assert (passed == (dots >= code.alpha))[sure].all() and passed.sum() > 500 and sure.mean() > 0.99


def test_filters_do_not_depend_on_the_session():
    plan = caps.plan(5000, 64, 0.93)
    a, b = caps.Code(plan), caps.Code(plan)
    v = np.random.default_rng(1).standard_normal((20, 64))
    assert [x.tolist() for x in a.decode(v)] == [x.tolist() for x in b.decode(v)]
    random.seed(1)
    assert [x.tolist() for x in caps.Code(plan).decode(v)] == [x.tolist() for x in b.decode(v)]
