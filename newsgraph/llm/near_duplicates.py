"""Near-duplicate classes by MinHash.

Universal hash minima of a document's word shingles are cut into bands of ``ROWS``;
documents that agree on a band are candidates (a pair at similarity 0.85 is missed with
probability (1 - 0.85**6)**28, about two in a million; the number of bands follows from the
threshold so that this holds for others too). Candidates are compared by signature,
those that may reach the threshold are confirmed on their full shingle sets, and the confirmed
links are closed by connected components.

Documents with the same shingle set are one representative throughout, so exact copies, however
many, cost one row. Candidate clusters of up to ``TOGETHER`` representatives are resolved side by
side in one task. A larger cluster never meets in one task: its members are dealt by their rarest
shingles (two sets at similarity t must share one among the n - ceil(t n) + 1 rarest of each), in
each such bucket a few central members are compared with the rest, components are closed, and
what is still apart goes into the next round with further members as centres, until no bucket
holds two components that have not been compared. No pair is left out and none inside a component
is made.

Edge cases: null and white-space texts have no shingles, link with nothing and stand alone; a text
of fewer than five words is one shingle; repeated rows of one doc_id share their class; rows
without doc_id are returned with a null class and kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import materialize
from newsgraph.operators.components import HOT_KEYS, connected_components, join_counted

WIDTH = 5
ROWS = 6
MISSED = 2e-6
# Minima compared when candidates are verified.
HASHES = 168
TOGETHER = 256
# Central members of a bucket compared in the first round, and how many times more in each next one.
CENTRES, GROWTH = 4, 16
# Tasks over which the members of one bucket are spread when they meet its centres; rows above which a shingle is hot.
SALTS, HOT_ROWS = 16, 10_000
CACHED_WORDS = 400_000
# A signature estimate this far below the threshold is out of reach: over five standard deviations.
MARGIN = 0.15

_P, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TAG
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    total = h[: n - width + 1].copy()
    for i in range(1, width):
        total = total * _P + h[i : n - width + 1 + i]
    return np.unique(_mix(total + np.uint64(width * int(_TAG) % (1 << 64))))


def bands_for(percent: int) -> int:
    """Fewest bands that miss a pair at the threshold with a probability of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)) - 0.2)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """One row of so many minima for each (non-empty) set."""
    draw = np.random.default_rng(20240229).integers(0, 1 << 63, (hashes, 2), np.uint64)
    a, b = draw[:, 0] * np.uint64(2) + np.uint64(1), draw[:, 1]
    out = np.empty((len(sets), hashes), np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 8192):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        cuts = np.cumsum([0, *map(len, sets[start : end - 1])])
        values = np.empty_like(x)
        for k in range(hashes):
            np.multiply(x, a[k], out=values)
            np.add(values, b[k], out=values)
            out[start:end, k] = np.minimum.reduceat(values, cuts)
        start = end
    return out


def _sign(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            if full:
                rows = signatures([sets[i] for i in full], count * ROWS).reshape(len(full), count, ROWS)
                band = np.arange(1, count + 1, dtype=np.uint64) * _TAG
                folded = np.broadcast_to(band, rows.shape[:2])
                for r in range(ROWS):
                    folded = _mix(folded * _P + rows[:, :, r])
                for k, i in enumerate(full):
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i] = folded[k].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with their full set and short signature."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            short = (signatures(sets) >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("cluster"), part.column("members"), part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in short], pa.binary())],
                names=["cluster", "members", "rep", "shingles", "signature"],
            )


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: 100 |a & b| >= percent |a | b|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def _resolve(percent: int):
    """Classes of one small cluster's members, compared side by side; rows are in order of rep, so a root is the least."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        reps = rows["rep"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
        root = list(range(len(reps)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(reps) - 1):
            alike = np.count_nonzero(sigs[i + 1 :] == sigs[i], axis=1)
            for j in (np.nonzero(alike >= (percent / 100 - MARGIN) * HASHES)[0] + i + 1).tolist():
                p, q = find(i), find(j)
                if p != q and linked(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
        return pd.DataFrame({"node": reps, "component": [reps[find(i)] for i in range(len(reps))]})

    return run


def _confirm(percent: int):
    """Pairs with both sides' signature and set; the linked ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(n).to_pylist() for n in ("a_signature", "b_signature", "a_shingles", "b_shingles")]
            for i, (sa, sb, a, b) in enumerate(zip(*columns, strict=True)):
                alike = np.count_nonzero(np.frombuffer(sa, np.uint32) == np.frombuffer(sb, np.uint32))
                if alike >= (percent / 100 - MARGIN) * HASHES and linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(keep, pa.int64())) for n in ("u", "v")], names=["u", "v"])

    return run


def _to_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))], names=["cluster", "rep", "shingles"])


def often_of(each: DataFrame) -> DataFrame:
    """In how many members of its cluster each shingle stands."""
    return each.groupBy("cluster", "shingle").agg(F.count("*").alias("often"))


def _large_classes(large: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the linked members of clusters too large for one task."""
    spark = large.sparkSession
    each = large.select("cluster", "rep", "shingles").mapInArrow(_to_longs, "cluster long, rep long, shingles array<long>")
    each = each.select("cluster", "rep", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    # A shingle of its own takes part only by pushing others back in the order of rarity.
    each = materialize(each, "near-each")
    hot = max(HOT_ROWS, each.count() // HOT_KEYS)
    rare = join_counted(each, often_of(each), ["cluster", "shingle"], hot, "often").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("order"))
    prefix = rare.select("rep", "n", F.posexplode(F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("place", "at"))
    entries = materialize(prefix.filter("at.often > 1").select(F.col("at.shingle").alias("key"), "rep", "n", F.col("place").cast("long").alias("place")), "near-entries")
    sets = large.select("rep", "shingles", "signature")
    links = spark.createDataFrame([], "u long, v long")
    component = spark.createDataFrame([], "node long, component long")
    used, centres = 0, CENTRES
    while True:
        # Ranks of centres are by place, the fewest rare shingles first; the first ``used`` of a key have met all others.
        now = entries.join(component, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "place", F.coalesce("component", "rep").alias("component"))
        now = materialize(now, "near-round")
        open_keys = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
        here = materialize(now.join(open_keys, "key", "left_semi"), "near-open")
        if here.isEmpty():
            return component
        chosen = _ranked(here, used, used + centres)
        # The members of a bucket are spread; its few centres go to each part of them.
        left = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("c")
        right = here.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).alias("m")
        both = F.least(F.col("c.n") - F.col("c.place"), F.col("m.n") - F.col("m.place"))
        fits = 100 * both >= percent * (F.col("c.n") + F.col("m.n") - both)
        pairs = left.join(right, (F.col("c.key") == F.col("m.key")) & (F.col("c.salt") == F.col("m.salt")) & (F.col("c.component") != F.col("m.component")) & fits)
        pairs = pairs.select(F.greatest("c.rep", "m.rep").alias("u"), F.least("c.rep", "m.rep").alias("v")).distinct()
        pairs = materialize(pairs, "near-pairs")
        found = pairs.join(_side(sets, "a", "u"), "u").join(_side(sets, "b", "v"), "v").mapInArrow(_confirm(percent), "u long, v long")
        found = materialize(found, "near-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            component = materialize(connected_components(links), "near-component")
        used, centres = used + centres, centres * GROWTH
        if entries.groupBy("key").count().filter(F.col("count") > used).isEmpty():
            return component


def _ranked(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of each key from rank ``start`` to ``end`` by place and rep; ranked in two steps, so a hot key is cut down in parts first."""
    from pyspark.sql import Window

    order = [F.col("place"), F.col("rep")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(64)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order))).filter(F.col("r") <= end)
    final = first.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return final.filter((F.col("r") > start) & (F.col("r") <= end)).drop("part", "r")


def _side(sets: DataFrame, side: str, key: str) -> DataFrame:
    return sets.select(F.col("rep").alias(key), F.col("shingles").alias(f"{side}_shingles"), F.col("signature").alias(f"{side}_signature"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept`` for ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(partial(_sign, count=bands_for(percent)), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "near-signed")
    reps = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    reps = materialize(reps, "near-reps")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).filter("size > 1").drop("size")
    stars = banded.join(buckets, "band").filter("rep != centre").select(F.col("rep").alias("u"), F.col("centre").alias("v"))
    clusters = connected_components(stars, "near-coarse").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    members = clusters.join(sizes, "cluster").select("rep", "cluster", "members")
    texts = docs.join(members.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    described = materialize(
        texts.select("cluster", "members", "rep", "text").mapInArrow(_describe, "cluster long, members long, rep long, shingles binary, signature binary"), "near-described"
    )
    classes = described.filter(F.col("members") <= TOGETHER).groupBy("cluster").applyInPandas(_resolve(percent), "node long, component long")
    large = described.filter(F.col("members") > TOGETHER)
    if not large.isEmpty():
        classes = classes.unionByName(_large_classes(large, percent))
    # One row a node, also where a repeated doc_id stands for several sets.
    classes = classes.groupBy("node").agg(F.min("component").alias("component"))
    placed = reps.select("set_key", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("bands").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
