"""What the vector searches share: shards of candidates, chunks of queries, and their pairs.

Candidates are dealt into shards of about ``rows`` vectors and queries into chunks, each packed into
one row of flat arrays; a task holds one shard while the chunks pass by, whatever the table's size.
Vectors of unequal length have no inner product and never meet: the length is part of every key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS = 512
# Chunks of queries that one sending of a shard serves.
CHUNKS_A_SENDING = 32


def valid(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part: no null id or vector, all components finite."""
    infinity = F.lit(float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity)))
    return rows.filter(F.exists("v", lambda x: x != 0)) if nonzero else rows


def dealt(rows: DataFrame, name: str, size: int, key: str = "vec_id") -> DataFrame:
    """``rows`` with ``dim``, the number of parts of that length and the part ``name`` of each row."""
    rows = rows.withColumn("dim", F.size("v"))
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return rows.join(parts, "dim").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int"))


def matrix(values: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))


def query_chunks(queries: DataFrame) -> DataFrame:
    """Rows ``dim, chunk, query_ids, queries`` with packed 64-bit ids and doubles."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "query_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "queries": [matrix(list(rows["v"])).tobytes()]})

    chunks = dealt(queries, "chunk", QUERY_ROWS).select("dim", "chunk", "vec_id", "v")
    return chunks.groupBy("dim", "chunk").applyInPandas(pack, "dim int, chunk int, query_ids binary, queries binary")


def beside(chunks: DataFrame, shards: DataFrame) -> DataFrame:
    """Every shard, followed by the chunks of queries of its length: blocks against blocks, not rows.

    A task gets rows in this order: ``kind`` 0, a shard, then ``kind`` 1, the chunks that it is to serve; columns
    of the other kind are null. A shard is sent once for ``CHUNKS_A_SENDING`` chunks and held while they pass.
    """
    counts = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = chunks.withColumn("sending", F.floor(F.col("chunk") / CHUNKS_A_SENDING).cast("int")).join(counts, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    sendings = chunks.groupBy("dim").agg(F.floor(F.max("chunk") / CHUNKS_A_SENDING).cast("int").alias("last"))
    held = shards.join(sendings, "dim").withColumn("sending", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    both = held.withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # The number is given, as tasks are made by their work and not by the little data that they read.
    tasks = held.select("dim", "shard", "sending").count()
    return both.repartition(max(1, min(4 * tasks, 20_000)), "dim", "shard", "sending").sortWithinPartitions("dim", "shard", "sending", "kind", "chunk")
