"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node with its smallest ids, so thousands of copies neither fill neighbour
lists nor hide other vectors. Distinct vectors are dealt into shards by length, the shortest into
the first, as graphs of vectors of much the same length find far more of the largest inner products;
there are at least ``BANDS`` of them but for small tables. A shard has up to ``SHARD_ROWS`` vectors, and more
where there would be over ``SHARDS``, so that the shards a query visits stay few, but never more than
``MOST_ROWS`` or ``MOST_BYTES``; the beam widens with the square root of the rows. Each shard gets a
graph whose level of a node is drawn geometrically from a hash of its id. Nodes are placed in steps
of up to ``CHUNK``: on each of its levels a node searches the graph as it stands, adds its companions
of the same step, links to diverse ones of those it found (a candidate closer to a kept neighbour
than to the node is passed over), and they link back, each list thinned likewise when it is full.
Lists are stored as flat arrays of ``2 * LINKS`` (bottom) or ``LINKS`` places.

A search walks greedily down the levels and keeps a beam of ``BEAM`` or more on the bottom one, many queries
in step; results of shards are merged. Inner product is searched as nearness of vectors lengthened
by one component to equal norm.

Edge cases: null, zero and non-finite vectors take no part; rows that share a vec_id are one
another's own; ties go to the smaller vec_id; with fewer candidates than k all those reached are
returned (a shard no larger than the beam is reached whole); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.tables import materialize
from newsgraph.llm.vectors import beside, matrix, query_chunks, valid

SHARD_ROWS = 8192
SHARDS, MOST_ROWS, MOST_BYTES = 256, 32_768, 64 << 20
BANDS, BAND_ROWS = 4, 1024
LINKS = 16
CANDIDATES = 64
BEAM = 128
WIDTH = 4
CHUNK = 512


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


def _diverse(x: np.ndarray, near: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """From candidates (rows, c) by falling score, -1 where none, up to ``keep`` diverse ones; passed-over ones fill up."""
    rows, c = near.shape
    vectors = x[np.maximum(near, 0)]
    between = np.einsum("rcd,red->rce", vectors, vectors)
    kept, count = np.zeros((rows, c), bool), np.zeros(rows, np.int64)
    for j in range(c):
        shadowed = (kept & (between[:, j, :] >= scores[:, j, None])).any(axis=1)
        take = (near[:, j] >= 0) & ~shadowed & (count < keep)
        kept[:, j] = take
        count += take
    rank = np.where(near < 0, 2 * c, np.where(kept, 0, c)) + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.full((rows, keep), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds to the lists of ``target`` the nodes ``source``; a list that would be too long keeps diverse ones."""
    room = links.shape[1]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    held = (links[nodes] >= 0).sum(axis=1)
    fits = held + counts <= room
    # All that fit, at the first free places.
    row = np.repeat(np.arange(len(nodes)), counts)
    place = held[row] + np.arange(len(source)) - starts[row]
    put = fits[row]
    links[target[put], place[put]] = source[put]
    # The others, few at a time: what the list holds and what is new, by nearness.
    full = np.nonzero(~fits)[0]
    for at in range(0, len(full), CHUNK):
        some = full[at : at + CHUNK]
        near = np.full((len(some), room + int(counts[some].max())), -1, np.int64)
        near[:, :room] = links[nodes[some]]
        inside = np.concatenate([np.arange(c) for c in counts[some]])
        rows = np.repeat(np.arange(len(some)), counts[some])
        near[rows, held[some][rows] + inside] = source[starts[some][rows] + inside]
        scores = np.where(near >= 0, np.einsum("rd,rcd->rc", x[nodes[some]], x[np.maximum(near, 0)]), -np.inf)
        best = np.argsort(-scores, axis=1, kind="stable")
        near, scores = np.take_along_axis(near, best, 1), np.take_along_axis(scores, best, 1)
        links[nodes[some]] = _diverse(x, near, scores, room)


def _insert(x: np.ndarray, arrays: list[np.ndarray], sizes: list[int], a: int, b: int) -> None:
    """Places nodes ``a`` to ``b`` into the graph of the nodes before them, level by level."""
    for h, links in enumerate(arrays):
        end = min(b, sizes[h])
        if a >= end:
            continue
        fresh = np.arange(a, end)
        scores = x[a:end] @ x[a:end].T
        scores[np.arange(end - a)[None, :] >= np.arange(end - a)[:, None]] = -np.inf
        near, got = np.broadcast_to(fresh, scores.shape), scores
        if a:
            # Of each level above, the nodes that are placed; a level is entered from the one above it.
            found, found_scores = search_graph(x[a:end], x[:a], [above[: min(a, n)] for above, n in zip(arrays[h:], sizes[h:], strict=True)], CANDIDATES)
            near, got = np.concatenate([found, near], 1), np.concatenate([found_scores, got], 1)
        best = _top(got, CANDIDATES)
        near, got = np.take_along_axis(near, best, 1), np.take_along_axis(got, best, 1)
        chosen = _diverse(x, np.where(np.isfinite(got), near, -1), got, LINKS)
        links[a:end, : chosen.shape[1]] = chosen
        source, target = np.repeat(fresh, chosen.shape[1]), chosen.ravel().astype(np.int64)
        _link_back(x, links, source[target >= 0], target[target >= 0])


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the id: 1 in LINKS reaches the next."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)), 6).astype(np.int64)


def build_graph(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order of placement, level of each node in it, and a neighbour array per level (rows: the nodes of the level)."""
    level = levels_of(ids)
    order = np.lexsort((ids, -level))  # upper nodes first, so a level's nodes are a prefix
    level = level[order]
    x = vectors[order]
    norms = np.einsum("nd,nd->n", x, x)
    x = np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)
    sizes = [int((level >= h).sum()) for h in range(int(level.max()) + 1)]
    arrays = [np.full((n, 2 * LINKS if h == 0 else LINKS), -1, np.int32) for h, n in enumerate(sizes)]
    a = 0
    while a < len(x):
        b = min(len(x), a + min(CHUNK, max(16, a // 2)))
        _insert(x, arrays, sizes, a, b)
        a = b
    return order, level, arrays


def search_graph(queries: np.ndarray, x: np.ndarray, arrays: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the beam of each query, best first; -1 where the beam is not full."""
    q, n = len(queries), len(x)
    rows = np.arange(q)
    top = len(arrays[-1])
    at = (queries @ x[:top].T).argmax(axis=1) if top <= 4 * LINKS else np.zeros(q, np.int64)
    score = np.einsum("qd,qd->q", queries, x[at])
    for links in arrays[:0:-1]:
        while True:
            near = links[at]
            scores = np.where(near >= 0, np.einsum("qd,qmd->qm", queries, x[np.maximum(near, 0)]), -np.inf)
            best = scores.argmax(axis=1)
            better = scores[rows, best] > score
            if not better.any():
                break
            at = np.where(better, near[rows, best], at)
            score = np.where(better, scores[rows, best], score)
    beam = min(beam, n)
    ids, scores, open_ = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf), np.zeros((q, beam), bool)
    ids[:, 0], scores[:, 0], open_[:, 0] = at, score, True
    seen = np.zeros((q, n + 1), bool)
    seen[rows, at] = True
    seen[:, n] = True
    live = rows
    while len(live):
        waiting = np.where(open_[live], scores[live], -np.inf)
        pick = _top(waiting, WIDTH)
        real = np.isfinite(np.take_along_axis(waiting, pick, 1))
        chosen = np.where(real, ids[live[:, None], pick], n)
        open_[live[:, None], pick] = False
        near = np.where(chosen[:, :, None] < n, arrays[0][np.minimum(chosen, n - 1)], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, n)
        seen[live[:, None], near] = True
        got = np.where(near < n, np.einsum("qd,qmd->qm", queries[live], x[np.minimum(near, n - 1)]), -np.inf)
        all_ids, all_scores = np.concatenate([ids[live], near], 1), np.concatenate([scores[live], got], 1)
        all_open = np.concatenate([open_[live], near < n], 1)
        keep = _top(all_scores, beam)
        ids[live], scores[live], open_[live] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_scores, all_open))
        live = live[(open_[live] & np.isfinite(scores[live])).any(axis=1)]
    return np.where(np.isfinite(scores), ids, -1), scores


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    ids, vectors = rows["vec_id"].to_numpy(np.int64), matrix(list(rows["v"]))
    order, level, arrays = build_graph(ids, vectors)
    members = rows["members"].to_numpy()[order]
    return pd.DataFrame(
        {
            "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "vectors": [vectors[order].tobytes()],
            "sizes": [[len(a) for a in arrays]], "links": [b"".join(a.tobytes() for a in arrays)], "members": [[list(map(int, m)) for m in members]],
        }
    )


def _unpack(sizes: list[int], links: bytes) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(links, np.int32), [], 0
    for h, n in enumerate(sizes):
        room = 2 * LINKS if h == 0 else LINKS
        out.append(flat[at : at + n * room].reshape(n, room))
        at += n * room
    return out


def beam_of(rows: int) -> int:
    """Wider in larger graphs."""
    return max(BEAM, int(np.ceil(BEAM * np.sqrt(rows / SHARD_ROWS))))


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = arrays = members = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    x, arrays, members = np.frombuffer(row.vectors).reshape(-1, row.dim), _unpack(list(row.sizes), row.links), row.members
                    continue
                query_ids = np.frombuffer(row.query_ids, np.int64)
                found, scores = search_graph(np.frombuffer(row.queries).reshape(len(query_ids), -1), x, arrays, beam_of(len(x)))
                out = []
                for q, (places, values) in enumerate(zip(found[:, : k + 1].tolist(), scores[:, : k + 1].tolist(), strict=True)):
                    hits = [(-s, m) for p, s in zip(places, values, strict=True) if p >= 0 for m in members[p] if m != query_ids[q]]
                    out += [(query_ids[q], m, -s) for s, m in sorted(hits)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _dealt(nodes: DataFrame, rows: int) -> DataFrame:
    """Nodes with ``dim`` and their shard: by length between 63 cuts that halve the table six times over; equal lengths are spread evenly."""
    sized = nodes.withColumn("dim", F.size("v")).withColumn("_long", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    cuts = F.percentile_approx("_long", [i / 64 for i in range(1, 64)], 10_000).alias("_cuts")
    fit = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(MOST_BYTES / 8 / F.greatest("dim", F.lit(1)))))
    parts = F.greatest(F.ceil(F.count("*") / fit), F.least(F.lit(BANDS), F.ceil(F.count("*") / BAND_ROWS))).cast("int").alias("_parts")
    known = sized.join(sized.groupBy("dim").agg(cuts, parts), "dim")
    below, upto = F.size(F.filter("_cuts", lambda c: c < F.col("_long"))), F.size(F.filter("_cuts", lambda c: c <= F.col("_long")))
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20)
    return known.withColumn("shard", F.floor((below + chance * (upto - below + 1)) / 64 * F.col("_parts")).cast("int")).drop("_long", "_cuts", "_parts")


def build(vectors: DataFrame, k: int = 20) -> DataFrame:
    """The index: one row per shard with vectors, flat neighbour arrays and the ids of each node (its k + 1 smallest, no more can be among k)."""
    rows = valid(vectors, nonzero=True).distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    rank = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    first = salted.withColumn("r", rank).filter(F.col("r") <= k + 1)
    final = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = final.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("vec_id", F.col("members")[0])
    nodes = materialize(nodes, "graph-nodes")
    rows = min(MOST_ROWS, max(SHARD_ROWS, -(-(total := nodes.count()) // SHARDS)))
    nodes = _dealt(nodes, rows).select("dim", "shard", "vec_id", "v", "members")
    # More parts than graphs, so that few tasks have two to build.
    shards = nodes.repartition(min(4 * -(-total // rows) + 1, 20_000), "dim", "shard").groupBy("dim", "shard").applyInPandas(_pack, "dim int, shard int, vectors binary, sizes array<int>, links binary, members array<array<long>>")
    return materialize(shards, "graph-shards")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k nearest found of every row that ``is_query`` admits."""
    shards = build(vectors, k)
    chunks = query_chunks(valid(vectors, nonzero=True).distinct().filter(is_query))
    found = beside(materialize(chunks, "graph-queries"), shards).drop("shard", "chunk", "sending").mapInPandas(_search(k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
