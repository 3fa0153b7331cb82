"""Yinyang clustering against measuring every distance."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from newsgraph.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def plain(rows, k, rounds, size, scale):
    """The contract, one vector after the other; (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        found = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
                if own:
                    centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True)], centroids


def check(spark, rows, k=5, rounds=3, groups=2, size=4, scale=8.0):
    df = spark.createDataFrame([(i, e, 0, "clash") for i, e in rows], SCHEMA).repartition(3)
    got = clustering.clustered(df, k, rounds, groups, size, scale).collect()
    expected, centroids = plain(rows, k, rounds, size, scale)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        assert r["inertia"] == sum(d for _, _, d in expected) and r["cluster_inertia"] == sum(d for _, j, d in expected if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    return got


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_equals_measuring_all(spark, groups):
    draw = random.Random(groups)
    rows = [(i, [draw.gauss(3 * (i % 4), 1.5) for _ in range(4)]) for i in range(300)]
    assert len(check(spark, rows, groups=groups, rounds=4)) == 300


def test_ties_and_odd_rows(spark):
    draw = random.Random(3)
    grid = [(i, [float(draw.randint(-1, 1)) for _ in range(4)]) for i in range(200)]  # many equal distances
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf")] + [0.0] * 3), (None, [0.5] * 4), (7, [2.0] * 4), (7, [2.0] * 4)]
    check(spark, grid + odd, k=6, groups=3, scale=1.0)


def test_few_and_none(spark):
    check(spark, [(1, [0.1, 0.2, 0.3, 0.4]), (2, [0.1, 0.2, 0.3, 0.4])], k=5)
    assert check(spark, [(1, None)]) == []
    empty = clustering.clustered(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(PySparkException):
        clustering.clustered(spark.createDataFrame([(1, [1e300] * 64, 0, "")], SCHEMA)).collect()


def test_bounds_hold_and_save_work():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.integers(-20, 20, (400, 8)) + 100 * c for c in range(12)]).astype(np.int64)
    centroids = x[draw.choice(len(x), 12, replace=False)]
    of_group = clustering.grouped(centroids, 3)
    cluster, upper, lower = clustering.assigned_first(x, centroids, of_group, int(of_group.max()) + 1)
    total = 0
    for _ in range(6):
        after = np.stack([x[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(12)])
        moved, centroids = np.sqrt(((after - centroids) ** 2).sum(axis=1)) * (1 + clustering.PAD), after
        cluster, upper, lower, measured = clustering.assigned_again(x, centroids, moved, of_group, cluster, upper, lower)
        total += measured
        far = np.stack([clustering.squares(x, c) for c in centroids], axis=1)
        assert (cluster == far.argmin(axis=1)).all()
        roots = np.sqrt(far)
        assert (upper >= roots[np.arange(len(x)), cluster]).all()
        roots[np.arange(len(x)), cluster] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= roots[:, of_group == g].min(axis=1, initial=np.inf)).all()
    assert total < len(x) * 12 * 6 / 2
