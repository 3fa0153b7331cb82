"""Centroid clustering by Yinyang grouping, in exact integers.

The centroids are put into groups once. Every vector keeps its centroid, an upper bound of the distance
to it and one lower bound a group for the distances to all others of that group. When centroids have
moved, the bounds move by as much; a vector whose least lower bound is beyond its upper bound keeps
its centroid (global filter), of the others only groups whose bound is not beyond are looked at (group
filter), and in these only centroids that their own move could have brought near enough (local filter).
What survives is measured in whole numbers, so ties are found and go to the smaller number; bounds
are padded by more than rounding could take.

The state of a round is one table in the shared folder: a round maps over it and sums each cluster with
partial sums in every task. The driver holds the k centroids and nothing that grows with the table.

Edge cases: vectors that are null, of another length or with null or non-finite components are left out;
a null id is kept and is never a first centroid before one with an id; repeated rows count as often as
they stand; with fewer vectors than k there are as many centroids as vectors; an empty table gives no
rows; a centroid without vectors stays where it is. Components beyond ``LARGEST`` after scaling are an
error, as squared distances would not fit 64 bits. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import drop_table, materialize

K, GROUPS, ROUNDS, SIZE, SCALE = 16, 4, 3, 64, 64.0
LARGEST = 1 << 26
# Vectors that a task compares at once, and the share by which bounds are padded.
BATCH_ROWS, PAD = 4096, 1e-12


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: float = SCALE) -> DataFrame:
    """``vec_id, v`` (array of long): floor(scale * component) of the vectors that take part."""
    infinity = F.lit(float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") == size)
    finite = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity)))
    fits = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("long"))
    return finite.select("vec_id", F.transform("v", fits).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of these."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """Group of each centroid: a few plain rounds over the first centroids, which start from evenly spaced ones."""
    groups = max(1, min(groups, len(centroids)))
    points = centroids.astype(np.float64)
    middle = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(5):
        of = ((points[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.stack([points[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(groups)])
    return of


def squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assigned_first(x: np.ndarray, centroids: np.ndarray, of_group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by group of vectors that have none yet: all centroids are measured."""
    far = np.stack([squares(x, c) for c in centroids], axis=1)
    cluster = far.argmin(axis=1)
    roots = np.sqrt(far)
    upper = roots[np.arange(len(x)), cluster] * (1 + PAD)
    roots[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([roots[:, of_group == g].min(axis=1, initial=np.inf) for g in range(groups)], axis=1)
    return cluster, upper, lower * (1 - PAD)


def assigned_again(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, of_group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved by at most ``moved``, and how many distances were measured."""
    groups = lower.shape[1]
    most = np.array([moved[of_group == g].max(initial=0.0) for g in range(groups)])
    less = lambda bound, by: bound - by - PAD * (np.where(np.isfinite(bound), bound, 0.0) + by)
    before = lower
    cluster, upper, lower = cluster.copy(), (upper + moved[cluster]) * (1 + PAD), less(lower, most)
    near = np.flatnonzero(lower.min(axis=1) <= upper)
    own = np.empty(len(near), np.int64)
    for c in np.unique(cluster[near]):
        at = np.flatnonzero(cluster[near] == c)
        own[at] = squares(x[near[at]], centroids[c])
    measured = len(near)
    upper[near] = np.sqrt(own) * (1 + PAD)
    still = lower[near].min(axis=1) <= upper[near]
    near, own = near[still], own[still]
    if not len(near):
        return cluster, upper, lower, measured
    # A lower bound for every centroid; exact roots where it was measured.
    bound = lower[near][:, of_group]
    best, best_at, old = own.copy(), cluster[near].copy(), cluster[near]
    bound[np.arange(len(near)), old] = np.sqrt(own) * (1 - PAD)
    open_group = lower[near] <= upper[near][:, None]
    for c in range(len(centroids)):
        g = of_group[c]
        alone = less(before[near][:, g], moved[c])
        survives = open_group[:, g] & (old != c)
        bound[survives, c] = alone[survives]
        at = np.flatnonzero(survives & (alone <= np.sqrt(best) * (1 + PAD)))
        if not len(at):
            continue
        far = squares(x[near[at]], centroids[c])
        measured += len(at)
        bound[at, c] = np.sqrt(far) * (1 - PAD)
        nearer = (far < best[at]) | ((far == best[at]) & (c < best_at[at]))
        best[at[nearer]], best_at[at[nearer]] = far[nearer], c
    bound[np.arange(len(near)), best_at] = np.inf
    for g in range(groups):
        lower[near, g] = bound[:, of_group == g].min(axis=1, initial=np.inf)
    cluster[near], upper[near] = best_at, np.sqrt(best) * (1 + PAD)
    return cluster, upper, lower, measured


STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, lower array<double>"


def _assign(centroids: np.ndarray, of_group: np.ndarray, moved: np.ndarray | None):
    groups = int(of_group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                if moved is None:
                    cluster, upper, lower = assigned_first(x, centroids, of_group, groups)
                else:
                    kept = [batch.column(c) for c in ("cluster", "upper", "lower")]
                    cluster, upper, lower, _ = assigned_again(x, centroids, moved, of_group, kept[0].to_numpy(), kept[1].to_numpy(), kept[2].flatten().to_numpy().reshape(-1, groups))
                apart = x - centroids[cluster]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, groups), pa.int32()), pa.array(lower.ravel()))
                columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(np.einsum("ij,ij->i", apart, apart)), pa.array(upper), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance", "upper", "lower"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors, in whole numbers."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])])
    after = centroids.copy()
    for r in sums.collect():  # one row a centroid
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return after


def clusters(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of rows (vec_id, v) after so many rounds of moving the centroids, and these."""
    of_group = grouped(centroids, groups)
    moved = None
    for n in range(rounds + 1):
        following = materialize(rows.mapInArrow(_assign(centroids, of_group, moved), STATE), "clusters", "zstd")
        if n:
            drop_table(rows.sparkSession, rows)
        rows = following
        if n < rounds:
            after = _moved(rows, centroids)
            moved = np.sqrt(((after - centroids) ** 2).sum(axis=1)) * (1 + PAD)
            centroids = after
    return rows.select("vec_id", "cluster", "distance"), centroids


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS, size: int = SIZE, scale: float = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the vectors that take part."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, size, scale)
    centroids = first_centroids(rows, k)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(spark.createDataFrame([], schema), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    found, centroids = clusters(rows, centroids, rounds, groups)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sorted(sums.items())]
    return found.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
