"""Token sequences in training order, as fixed-stride binary shards.

Every text is encoded, ended with the separator id and cut into sequences of ``LENGTH`` ids. The
sequences are numbered densely in the order of a hash of (doc_id, text), then doc_id, then place in
the document, so a number depends on the rows alone, not on files, partitions or cores. A keyed
Feistel network over the smallest even number of bits that holds all numbers permutes them, walking
the cycle until the result is in range again, so every sequence has a global slot of its own.
``write_shards`` deals slots by range and packs each range into shards of ``SLOTS`` records of equal
stride; slot s lies in shard s // SLOTS at byte (s % SLOTS) * STRIDE of its data. ``read_from`` reads
on from any slot.

A record is doc_id (int64, its least value for null), number of the sequence in the document
(int32), ids in use (int32) and LENGTH unsigned 16-bit ids, little-endian; unused places hold the
separator. Shards are rows of a table written by Spark; a lost executor's shards are written again.

Ids move once, to their slots. Numbers are settled on a table without texts (hash, doc_id, count of
sequences) and meet the ids part by part: the encoded table is bucketed by part as it is written, so
the join moves numbers only.

Edge cases: null and empty texts are one sequence, the separator alone; repeated rows have slots of
their own (which of two equal rows has which is of no effect, as their records are equal); an empty
table gives no shards; other columns are ignored; a special token in a text is its id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.bpe import vocabulary
from newsgraph.tables import drop_table, materialize, materialize_bucketed

LENGTH = 512
SLOTS = 1024
STRIDE = 16 + 2 * LENGTH
SEPARATOR = "<|endoftext|>"
ROUNDS = 4
KEY = 20240601
NO_ID = -(1 << 63)
# Rows of a part (one array of numbers each), of a bucket of parts, and of a range of the numbering.
PART_ROWS = 4096
BUCKET_ROWS = 4 * PART_ROWS
MAX_BUCKETS = 65_536
NUMBER_ROWS = 65_536
# Longer words are merged by our own encoder, in n log n.
LONG_WORD = 1000


def feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """Keyed permutation of [0, 2**(2 * bits))."""
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for r in range(ROUNDS):
        h = (right + np.uint64((key * ROUNDS + r + 1) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
    return (left << shift) | right


def slots_of(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Slot of each number in [0, total): the permutation, repeated where it leads out of range."""
    bits = max(1, -(-max(1, (total - 1).bit_length()) // 2))
    out = feistel(numbers.astype(np.uint64), bits, key)
    while (outside := out >= np.uint64(total)).any():
        out[outside] = feistel(out[outside], bits, key)
    return out.astype(np.int64)


@lru_cache(maxsize=4)
def encoder(tokenizer: str) -> Callable[[str], np.ndarray]:
    """Text to 16-bit ids, the separator last; by the compiled library where the vocabulary's ids stand in order of its merges."""
    words = vocabulary(tokenizer)
    if len(words.token_bytes) > 1 << 16:
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    end = np.array([words.special[SEPARATOR]], "<u2")
    special = set(words.special.values())
    compiled = None
    if words.result == sorted(words.result):
        ranks = {token: i for i, token in enumerate(words.token_bytes) if i not in special}
        compiled = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str | None) -> np.ndarray:
        text = text or ""
        plain = compiled and not any(t in text for t in words.special) and max(map(len, text.split()), default=0) < LONG_WORD
        ids = np.array(compiled(text), "<u2") if plain else np.frombuffer(words.encode(text), "<u4").astype("<u2")
        return np.concatenate([ids, end])

    return encode


def sequences(docs: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """The encoded table: ``part, place, hash, doc_id, count, ids`` (16-bit ids), written in buckets of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row, first = encoder(tokenizer), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [encode(text) for text in some.column("text").to_pylist()]
                rows = np.arange(row, row + len(ids))
                row += len(ids)
                columns = [pa.array(first + rows // PART_ROWS), pa.array(rows % PART_ROWS), some.column("hash"), some.column("doc_id")]
                columns += [pa.array([-(-len(i) // LENGTH) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "hash", "doc_id", "count", "ids"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", F.xxhash64(doc_id, "text").alias("hash"))
    return materialize_bucketed(rows.mapInArrow(run, "part long, place long, hash long, doc_id long, count long, ids binary"), "train-ids", buckets, "part")


def numbered(encoded: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """(``first, count, doc_id, ids``: the number of each document's first sequence, number of all sequences)."""
    spark = encoded.sparkSession
    light = encoded.select("part", "place", "hash", "doc_id", "count")
    ranges = max(1, -(-encoded.count() // NUMBER_ROWS))
    # Equal ranges of the hash, which is uniform: the top 32 bits, from 0 on, times the ranges.
    light = light.withColumn("range", F.shiftright((F.shiftright("hash", 32) + F.lit(1 << 31)) * F.lit(ranges), 32))
    # One sum per NUMBER_ROWS documents.
    sums = sorted((r["range"], r["n"]) for r in light.groupBy("range").agg(F.sum("count").alias("n")).toLocalIterator())
    ends = np.cumsum([n for _, n in sums], dtype=np.int64).tolist()
    offsets = spark.createDataFrame([(r, end - n) for (r, n), end in zip(sums, ends, strict=True)], "range long, offset long")
    before = Window.partitionBy("range").orderBy("hash", "doc_id", "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).join(offsets, "range")
    # Dealt as the buckets are, so that the ids stay where they were written.
    of_part = placed.repartition(buckets, "part").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("offset") + F.col("ahead")).alias("first")))).alias("firsts"))
    found = encoded.join(of_part.select("part", F.col("firsts.first").alias("firsts")), "part")
    return found.select(F.element_at("firsts", (F.col("place") + 1).cast("int")).alias("first"), "count", "doc_id", "ids"), ends[-1] if ends else 0


def write_shards(docs: DataFrame, tokenizer: str, key: int = KEY) -> DataFrame:
    """Shards as a written table: ``shard, first_slot, records, data``."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, -(-docs.count() // BUCKET_ROWS)))
    encoded = sequences(docs, tokenizer, buckets)
    each, total = numbered(encoded, buckets)
    separator = vocabulary(tokenizer).special[SEPARATOR]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [c.to_pylist() for c in batch.slice(at, 256).columns]
                numbers = np.concatenate([np.arange(n, dtype=np.int64) + f for f, n in zip(rows[0], rows[1], strict=True)])
                out = np.zeros(len(numbers), np.dtype([("doc_id", "<i8"), ("number", "<i4"), ("used", "<i4"), ("ids", "<u2", LENGTH)]))
                out["ids"] = separator
                row = 0
                for n, doc_id, data in zip(rows[1], rows[2], rows[3], strict=True):
                    ids = np.frombuffer(data, "<u2")
                    flat = out["ids"][row : row + n]
                    whole = len(ids) // LENGTH
                    flat[:whole] = ids[: whole * LENGTH].reshape(whole, LENGTH)
                    if whole < n:
                        flat[whole, : len(ids) - whole * LENGTH] = ids[whole * LENGTH :]
                    out["doc_id"][row : row + n] = NO_ID if doc_id is None else doc_id
                    out["number"][row : row + n] = np.arange(n)
                    out["used"][row : row + n] = np.minimum(LENGTH, len(ids) - LENGTH * np.arange(n))
                    row += n
                packed = out.tobytes()
                slots = slots_of(numbers, total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([packed[i : i + STRIDE] for i in range(0, len(packed), STRIDE)], pa.binary())], names=["slot", "record"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([now * SLOTS], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["shard", "first_slot", "records", "data"])

        for batch in batches:
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if slot // SLOTS != now and held:
                    yield shard()
                    held = []
                now = slot // SLOTS
                held.append(data)
        if held:
            yield shard()

    count = max(1, -(-total // SLOTS))
    parts = max(1, min(count, -(-total // (16 * SLOTS))))
    dealt = each.mapInArrow(records, "slot long, record binary")
    # Ranges of slots are known without sampling: as many whole shards to each partition.
    ranged = dealt.repartitionById(parts, (F.floor(F.col("slot") / SLOTS) * parts / count).cast("int")).sortWithinPartitions("slot")
    written = materialize(ranged.mapInArrow(shards, "shard long, first_slot long, records long, data binary"), "train-shards", "zstd")
    drop_table(spark, encoded)
    return written


def read_from(shards: DataFrame, slot: int = 0) -> DataFrame:
    """``slot, doc_id, number, n_ids, ids, crc32`` from a slot on; earlier shards are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("doc_id", "<i8"), ("number", "<i4"), ("used", "<i4"), ("ids", "<u2", LENGTH)])
        for batch in batches:
            for first, data in zip(batch.column("first_slot").to_pylist(), batch.column("data").to_pylist(), strict=True):
                skip = max(0, slot - first)
                rows = np.frombuffer(data, kind, offset=skip * STRIDE)
                ids = [r["ids"][: r["used"]].tobytes() for r in rows]
                docs = pa.array([None if d == NO_ID else d for d in rows["doc_id"].tolist()], pa.int64())
                crc = pa.array([zlib.crc32(i) for i in ids], pa.int64())
                columns = [pa.array(np.arange(first + skip, first + skip + len(rows))), docs, pa.array(rows["number"].astype(np.int64)), pa.array(rows["used"].astype(np.int64)), pa.array(ids, pa.binary()), crc]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "doc_id", "number", "n_ids", "ids", "crc32"])

    return shards.filter(F.col("shard") >= slot // SLOTS).select("first_slot", "data").mapInArrow(run, "slot long, doc_id long, number long, n_ids long, ids binary, crc32 long")
