"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents, dimensions terms, integer components weights. A shard's rows are ordered by
their strongest term and cut into ranges of ``BLOCK_ROWS``; each range has, per term, its largest
and smallest weight and a forward index (its weight matrix). For every query the ranges are taken
in the order of their bounds, the sum over terms of what the range could contribute at most, and
scored whole, until the next bound falls below the query's k-th score (an equal bound may still
hold a smaller id, so it is scored). Every query starts with a first bound that all shards share: its
k-th score among the ``FIRST_ROWS`` longest vectors, which no result can be below.

Edge cases: rows with null ids or vectors or non-finite components take no part; a zero or empty
vector does, with score 0; rows that share a vec_id are one another's own and never match; ties go
to the smaller vec_id; with fewer candidates than k all are returned; an empty table gives no rows.
Scores are 64-bit integers: vectors whose products go beyond them have no defined order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.tables import materialize
from newsgraph.llm.vectors import beside, dealt, matrix, query_chunks, valid

SHARD_ROWS = 8192
BLOCK_ROWS = 128
FIRST_ROWS = 1024
EXACT = 1 << 53
# Below every score.
NOTHING = -(1 << 62)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard: ids and weights in block order."""
    ids, weights = rows["vec_id"].to_numpy(np.int64), matrix(list(rows["v"]))
    if weights.shape[1]:
        strongest = np.abs(weights).argmax(axis=1)
        sign = weights[np.arange(len(ids)), strongest] > 0
        order = np.lexsort((ids, sign, strongest))
    else:
        order = np.argsort(ids, kind="stable")
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "ids": [ids[order].tobytes()], "weights": [weights[order].tobytes()]})


def top_of_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (queries, k) of a shard's best, by score then id, of those that are not below the first bounds; missing ones have id -1."""
    first = np.full(len(query_ids), NOTHING) if first is None else first
    n, cuts = len(query_ids), np.arange(0, len(ids), BLOCK_ROWS)
    if queries.size and weights.size and np.abs(queries).max() * np.abs(weights).max() * queries.shape[1] >= EXACT:
        queries, weights = queries.astype(np.int64), weights.astype(np.int64)
    high, low = np.maximum.reduceat(weights, cuts), np.minimum.reduceat(weights, cuts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_ids, best = np.full((n, k), -1, np.int64), np.full((n, k), NOTHING, np.int64)
    live = np.arange(n)
    for step in range(len(cuts)):
        at = order[live, step]
        go = bounds[live, at] >= np.maximum(best[live, k - 1], first[live])
        live, at = live[go], at[go]
        if not len(live):
            break
        by_block = np.argsort(at, kind="stable")
        for part in np.split(by_block, np.nonzero(np.diff(at[by_block]))[0] + 1):
            rows, start = live[part], cuts[at[part[0]]]
            block_ids = ids[start : start + BLOCK_ROWS]
            scores = (queries[rows] @ weights[start : start + BLOCK_ROWS].T).astype(np.int64)
            own = query_ids[rows][:, None] == block_ids[None, :]
            all_ids = np.concatenate([best_ids[rows], np.where(own, -1, block_ids[None, :])], axis=1)
            scores = np.concatenate([best[rows], np.where(own, NOTHING, scores)], axis=1)
            chosen = np.lexsort((all_ids, -(scores.astype(np.float64) if weights.dtype != np.int64 else scores)), axis=1)[:, :k]
            best_ids[rows], best[rows] = np.take_along_axis(all_ids, chosen, 1), np.take_along_axis(scores, chosen, 1)
    return best_ids, best


def _first_bounds(k: int, longest: np.ndarray, weights: np.ndarray):
    """Adds to each chunk of queries its k-th scores among the longest vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = []
            for row in batch.itertuples(index=False):
                query_ids = np.frombuffer(row.query_ids, np.int64)
                queries = np.frombuffer(row.queries).reshape(len(query_ids), -1)
                fits = len(longest) and queries.shape[1] == weights.shape[1]
                bounds.append((top_of_shard(query_ids, queries, longest, weights, k)[1][:, -1] if fits else np.full(len(query_ids), NOTHING)).tobytes())
            yield batch.assign(bounds=bounds)

    return run


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = weights = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    ids = np.frombuffer(row.ids, np.int64)
                    weights = np.frombuffer(row.weights).reshape(len(ids), -1)
                    continue
                query_ids = np.frombuffer(row.query_ids, np.int64)
                found, scores = top_of_shard(query_ids, np.frombuffer(row.queries).reshape(len(query_ids), -1), ids, weights, k, np.frombuffer(row.bounds, np.int64))
                q, i = np.nonzero(scores > NOTHING)
                yield pd.DataFrame({"query_id": query_ids[q], "vec_id": found[q, i], "score": scores[q, i]})

    return run


def _longest(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of the ``FIRST_ROWS`` longest vectors of the commonest length; they go to all tasks."""
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if size is None:
        return np.empty(0, np.int64), np.empty((0, 0))
    long = rows.filter(F.size("v") == size["dim"]).orderBy(F.desc(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), "vec_id").limit(FIRST_ROWS).collect()
    return np.array([r["vec_id"] for r in long], np.int64), matrix([r["v"] for r in long])


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` over weights floor(scale * component)."""
    rows = valid(vectors, nonzero=False).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = materialize(rows, "exact-rows")
    shards = dealt(rows, "shard", SHARD_ROWS).select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInPandas(_pack, "dim int, shard int, ids binary, weights binary")
    shards = materialize(shards, "exact-shards")
    chunks = query_chunks(rows.filter(is_query))
    chunks = materialize(chunks.mapInPandas(_first_bounds(k, *_longest(rows)), "dim int, chunk int, query_ids binary, queries binary, bounds binary"), "exact-queries")
    found = beside(chunks, shards).select("kind", "query_ids", "queries", "bounds", "ids", "weights").mapInPandas(_search(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
