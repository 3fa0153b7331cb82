"""Mixing sources to target weights by exact block quotas.

Every document falls into a block of its source by a keyed hash; a source has about one block per
``BLOCK_WORDS`` words and ``MAX_BLOCKS`` at most (blocks then grow instead, so the block table is
bounded by the number of sources). A source's target is met by whole passes over its blocks, the
blocks of each pass in a keyed order, and one pass that ends where the target is reached, inside a
document if need be. The blocks so drawn are the source's quota. A tree splits the quotas of all
sources over the output shards: at each node the left half gets a multivariate-hypergeometric
draw of the node's blocks, so every shard is a fair sample of the mix and the quotas are met
exactly. Shards take disjoint runs of each source's drawn blocks and are shuffled locally.

The driver holds one row per source (name, size) and the shard quotas; documents and blocks are
only ever joined and summed in parts.

Edge cases: a null text counts no words, and a text without words has one draw of none, in a shard by
its key, so that it isn't lost; the null source is a source of its own, last in order; a
source without words gets the target 0; an empty table gives no rows; rows are never merged, so
repeated rows count and are drawn each for themselves; reruns agree, as every choice is a hash of
the row or seeded by its place in the tree. Columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.tables import materialize

BLOCK_WORDS = 8192
MAX_BLOCKS = 65_536
BLOCKS_PER_SHARD = 64
MAX_SHARDS = 1024
REPEATS = 3
# Sources whose table of a few numbers a row is sent to all tasks; beyond, Spark joins by shuffle.
SENT_SOURCES = 10_000
SEED = 20240517
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total by weight; what exceeds ``repeats`` times a source's size goes to the others by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > repeats * sizes[i]]
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, colours: np.ndarray) -> None:
        if high - low == 1:
            out[low] = colours
            return
        middle = (low + high) // 2
        count = int(colours.sum()) * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high])
        left = draw.multivariate_hypergeometric(colours, count, method="marginals") if colours.any() else colours
        split(low, middle, left)
        split(middle, high, colours - left)

    split(0, shards, np.array(quotas, np.int64))
    return out


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int

    @property
    def words(self) -> int:
        return min(round(self.target), REPEATS * self.size)


def sources_of(sized: DataFrame) -> list[Source]:
    """Sources in order of code points, null last, weighing 1, 2, 3 in turn."""
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).toLocalIterator(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    aims = targets(sizes, [float(1 + i % 3) for i in range(len(rows))])
    blocks = [min(MAX_BLOCKS, max(1, -(-s // BLOCK_WORDS))) for s in sizes]
    return [Source(r["source"], s, a, b) for r, s, a, b in zip(rows, sizes, aims, blocks, strict=True)]


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` in words and ``mix_key``, the hash by which the row is dealt."""
    sized = docs.drop("size", "mix_key").withColumn("size", word_count())
    return sized.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.xxhash64("text")))


def mix(measured: DataFrame, seed: int = SEED) -> DataFrame:
    """``measured`` (see ``measure``) with ``source_size``, ``target`` and ``draws``.

    ``draws`` is an array of (shard, pass, words, place): the shard that takes the document, the pass
    over its source, the words taken from its start (its size, or less where the target is reached)
    and the keyed place in the shard. At most REPEATS draws add up to REPEATS times the size.
    """
    spark = measured.sparkSession
    measured = measured.drop("source_size", "target", "draws")
    light = materialize(measured.select("source", "size", "mix_key"), "mix-sizes")
    sources = sources_of(light)
    names = [(i, s.name, s.size, s.target, s.blocks, s.words) for i, s in enumerate(sources)]
    of_source = spark.createDataFrame(names, "_s long, _name string, source_size long, target double, _blocks long, _words long")
    if len(sources) <= SENT_SOURCES:
        of_source = F.broadcast(of_source)  # else texts would be shuffled by source, the hottest of keys

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(of_source, F.col("source").eqNullSafe(F.col("_name")))
        return rows.withColumn("_block", F.pmod(F.col("mix_key"), F.col("_blocks")))

    # Blocks with the passes that draw them; the last pass ends inside the block that reaches the target.
    keyed = Window.partitionBy("_s", "_pass").orderBy(F.xxhash64(F.lit(seed), "_s", "_pass", "_block"), "_block")
    block = placed(light).groupBy("_s", "_block").agg(F.sum("size").alias("_held"), F.first("source_size").alias("_all"), F.first("_words").alias("_want"))
    passes = block.filter("_held > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("_rest", F.col("_want") - F.col("_pass") * F.col("_all"))
    drawn = passes.filter("_rest > 0").withColumn("_before", F.coalesce(F.sum("_held").over(keyed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drawn = drawn.filter("_before < _rest").withColumn("_upto", F.least(F.col("_held"), F.col("_rest") - F.col("_before")))
    slot = Window.partitionBy("_s").orderBy("_pass", "_before", "_block")
    drawn = drawn.withColumn("_slot", F.row_number().over(slot) - 1)

    quotas = {r["_s"]: r["n"] for r in drawn.groupBy("_s").agg(F.count("*").alias("n")).toLocalIterator()}
    counts = [quotas.get(i, 0) for i in range(len(sources))]
    shards = min(MAX_SHARDS, max(1, sum(counts) // BLOCKS_PER_SHARD))
    ends = np.cumsum(split_quotas(counts, shards, seed), axis=0)
    runs = spark.createDataFrame([(i, ends[:, i].tolist()) for i in range(len(sources))], "_s long, _ends array<long>")
    drawn = drawn.join(runs, "_s").withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= F.col("_slot"))))
    drawn = drawn.groupBy("_s", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_pass").alias("pass"), F.col("_shard").alias("shard"), F.col("_upto").alias("upto"), F.col("_held").alias("held")))).alias("_drawn"))

    # One path for all rows, so each text is shuffled once; only in the block where a target is reached do the words ahead count.
    within = Window.partitionBy("_s", "_block").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed(measured).join(drawn.hint("shuffle_hash"), ["_s", "_block"], "left")
    joined = joined.withColumn("_ahead", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    words = lambda d: F.when(d["upto"] < d["held"], F.least(F.col("size"), F.greatest(d["upto"] - F.col("_ahead"), F.lit(0)))).otherwise(F.col("size"))
    draw = lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"), words(d).alias("words"), F.xxhash64(F.lit(seed), F.col("mix_key"), d["pass"]).alias("place"))
    drawn_rows = F.filter(F.transform(F.coalesce("_drawn", F.array().cast("array<struct<pass:int,shard:int,upto:bigint,held:bigint>>")), draw), lambda d: d["words"] > 0)
    wordless = F.array(F.struct(F.pmod("mix_key", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("pass"), F.lit(0).cast("long").alias("words"), F.xxhash64(F.lit(seed), "mix_key", F.lit(0)).alias("place")))
    return joined.select(*measured.columns, "source_size", "target", F.when(F.col("size") == 0, wordless).otherwise(drawn_rows).alias("draws"))


def shards(mixed: DataFrame) -> DataFrame:
    """One row per draw, dealt by shard and shuffled within it: the columns of ``mixed`` with ``shard`` and ``place``.

    Texts stay whole: that of the one document at which a source's target is reached passes it by its rest.
    """
    each = mixed.withColumn("_draw", F.explode("draws")).drop("draws")
    each = each.withColumn("shard", F.col("_draw.shard")).withColumn("place", F.col("_draw.place"))
    return each.drop("_draw").repartition("shard", F.pmod("place", F.lit(8))).sortWithinPartitions("shard", "place")
