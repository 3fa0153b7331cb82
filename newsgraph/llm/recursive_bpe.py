"""Byte-level BPE by recursive queries of an in-process DuckDB, one database a Python worker: ``encode`` and ``decode``.

The words of a batch that the worker has not seen yet become rows (word, position, token). A recursive
query joins neighbouring tokens with the merge table, contracts each word's leftmost pair of least rank
and repeats until no word has a pair left. Decoding joins ids with the vocabulary and concatenates in
the order of positions. Both sides of every batch are bounded, whatever the size of a partition.

A word of more than ``SHORT`` bytes is first cut where no token of the vocabulary could reach across,
which changes nothing. A piece that is still longer takes, in one round, the leftmost pair and all its
repeats up to the first one that would bring forth a pair of lower rank: the same merges in the same
order, in fewer rounds. Its rounds run in queries of bounded size, each going on where the last ended.

A word that is itself in the vocabulary is that one token. Special tokens have no meaning in texts.

Edge cases: a null text encodes as the empty text (no ids), null ids decode to no bytes, null ids within
an array and ids outside the vocabulary to nothing. Rows are never dropped or joined, so repeated ids
and extra columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsgraph.llm.bpe import split_words

# Bytes up to which a word takes one merge a round.
SHORT = 64
# Rows that one recursive query starts from, and that it may add up to over all its rounds.
START_ROWS, ALL_ROWS = 300_000, 3_000_000
CACHED_WORDS = 300_000
# Characters of text and number of ids that are handled at once.
BATCH_CHARS, BATCH_IDS = 2_000_000, 500_000

# Each token with the one after it and the rank of the pair that they make, if they do.
_RANKED = """
    SELECT n.*, m.rank FROM (SELECT *, lead(id) OVER w AS next, lead(word) OVER w AS next_word, lead(pos) OVER w AS next_pos FROM {rows} WINDOW w AS (ORDER BY pos)) n
    LEFT JOIN merges m ON m.pair = CASE WHEN n.word = n.next_word THEN (n.id::BIGINT << 32) | n.next END"""
_LAST_ROUND = "SELECT s.* FROM s JOIN (SELECT word, max(round) AS last FROM s GROUP BY word) e ON e.word = s.word AND s.round = e.last"

# Every word with a pair left contracts the leftmost pair of least rank. A key is the pair's rank, place (24 bits) and width of its left token (8 bits).
_KEY = "((rank::BIGINT << 32) | (pos << 8)) | (next_pos - pos)"
SHORT_WORDS = f"""
    WITH RECURSIVE s(round, word, pos, id, key) AS (
        SELECT 0, word, pos, id, {_KEY} FROM ({_RANKED.format(rows="start")})
        UNION ALL (
            WITH b AS MATERIALIZED (SELECT word, min(key) AS k FROM s WHERE key IS NOT NULL AND round < {SHORT} GROUP BY word),
            x AS (SELECT s.*, k, (k >> 8) & 16777215 AS spot FROM s JOIN b USING (word)),
            z AS (SELECT round + 1 AS round, word, pos, CASE WHEN pos = spot THEN (k >> 32)::INTEGER ELSE id END AS id FROM x WHERE pos <> spot + (k & 255))
            SELECT round, word, pos, id, {_KEY} FROM ({_RANKED.format(rows="z")})
        )
    ) SELECT word, pos, id FROM ({_LAST_ROUND}) ORDER BY pos"""

# As above; of the repeats of a pair that follow one another every second one is contracted, from the left,
# up to the first one with a neighbour with which it makes a pair of lower rank.
LONG_WORDS = f"""
    WITH RECURSIVE s(round, word, pos, id, rank) AS (
        SELECT 0, word, pos, id, rank FROM ({_RANKED.format(rows="start")})
        UNION ALL (
            WITH b AS MATERIALIZED (SELECT word, min(rank) AS merged FROM s WHERE rank IS NOT NULL AND round < {{rounds}} GROUP BY word),
            x AS (
                SELECT s.*, merged, rank IS NOT NULL AND rank = merged AS hit, row_number() OVER w AS i,
                    lead(id, 2) OVER w AS right_id, lead(s.word, 2) OVER w = s.word AS has_right
                FROM s JOIN b USING (word) WINDOW w AS (ORDER BY pos)
            ),
            h AS (SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS able FROM x),
            l AS (SELECT *, CASE WHEN lag(able, 2, false) OVER w THEN merged ELSE lag(id) OVER w END AS left_id, lag(word) OVER w = word AS has_left FROM h WINDOW w AS (ORDER BY pos)),
            low AS (
                SELECT l.word, min(l.pos) AS stop FROM l
                LEFT JOIN merges a ON a.pair = CASE WHEN able AND has_left THEN (left_id::BIGINT << 32) | merged END
                LEFT JOIN merges c ON c.pair = CASE WHEN able AND has_right THEN (merged::BIGINT << 32) | right_id END
                WHERE able AND least(coalesce(a.rank, merged), coalesce(c.rank, merged)) < merged GROUP BY l.word
            ),
            t AS (SELECT l.*, able AND pos <= coalesce(stop, pos) AS taken FROM l LEFT JOIN low USING (word)),
            y AS (SELECT *, lag(taken, 1, false) OVER (ORDER BY pos) AS gone FROM t),
            z AS (SELECT round + 1 AS round, word, pos, CASE WHEN taken THEN merged ELSE id END AS id FROM y WHERE NOT gone)
            SELECT round, word, pos, id, rank FROM ({_RANKED.format(rows="z")})
        )
    ) SELECT word, pos, id, max(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY word) = 1 AS going FROM ({_LAST_ROUND}) ORDER BY pos"""

DECODED = "SELECT string_agg(letters, '' ORDER BY place) FROM batch JOIN vocabulary USING (id)"


class Merges:
    """A rank file as tables of an in-memory database, and the words met so far with their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.spans = np.zeros(1 << 16, bool)  # two bytes that some token holds side by side
        for t in self.ranks:
            for x, y in zip(t, t[1:], strict=False):
                self.spans[x << 8 | y] = True
        self.base = duckdb.connect()
        self.base.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''; SET enable_progress_bar = false")
        self._table("merges", pair=left << 32 | right, rank=rank.astype(np.int32))
        # A byte is written as the character of its number.
        self._table("vocabulary", id=np.fromiter(self.ranks.values(), np.int32), letters=[t.decode("latin-1") for t in self.ranks])
        self.widths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for t, i in self.ranks.items():
            self.widths[i] = len(t)
        self.words: dict[str, bytes] = {}

    def _table(self, name: str, **columns) -> None:
        self.base.register("given", pa.table(columns))
        self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def _rows(self, sql: str, **columns) -> pa.Table:
        self.base.register("start", pa.table(columns))
        found = self.base.sql(sql).to_arrow_table()
        self.base.unregister("start")
        return found

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; short words by one query, long ones by as many as they need."""
        sizes = np.array([len(w) for w in words])
        out = [b""] * len(words)
        for numbers, sql in ((np.flatnonzero(sizes <= SHORT), SHORT_WORDS), (np.flatnonzero(sizes > SHORT), LONG_WORDS)):
            for part in _runs(numbers, sizes, START_ROWS):
                flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                word, pos, ids = np.repeat(part.astype(np.int32), sizes[part]), np.arange(len(flat), dtype=np.int32), self.byte_id[flat]
                while len(word):
                    found = self._rows(sql.replace("{rounds}", str(max(8, ALL_ROWS // len(word)))), word=word, pos=pos, id=ids)
                    word, pos, ids = (found.column(c).to_numpy() for c in ("word", "pos", "id"))
                    going = found.column("going").to_numpy() if sql is LONG_WORDS else np.zeros(len(word), bool)
                    ended, packed = word[~going], ids[~going].tobytes()
                    starts = np.flatnonzero(np.r_[True, np.diff(ended) != 0][: len(ended)])
                    ends = [*(starts[1:] * 4).tolist(), len(packed)]
                    for number, a, b in zip(ended[starts].tolist(), (starts * 4).tolist(), ends, strict=False):
                        out[number] = packed[a:b]
                    word, pos, ids = word[going], pos[going], ids[going]
        return out

    def _pieces(self, word: bytes) -> list[bytes]:
        """Pieces of a long word that no token reaches beyond."""
        flat = np.frombuffer(word, np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.spans[flat[:-1] << 8 | flat[1:]]) + 1
        ends = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of words into ``self.words``, as packed 32-bit integers."""
        whole, cut = {}, {}
        for w in words:
            data = w.encode("utf-8")
            if (i := self.ranks.get(data)) is not None:
                self.words[w] = np.int32(i).tobytes()
            elif len(data) <= SHORT:
                whole[w] = data
            else:
                cut[w] = self._pieces(data)
        known = dict.fromkeys(whole.values()) | dict.fromkeys(p for pieces in cut.values() for p in pieces)
        pieces = list(known)
        known = dict(zip(pieces, self._merged(pieces), strict=True))
        self.words.update((w, known[data]) for w, data in whole.items())
        self.words.update((w, b"".join(map(known.__getitem__, of_word))) for w, of_word in cut.items())

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        pieces = [split_words(t or "") for t in texts]
        met = set().union(*pieces)
        missing = met - self.words.keys()
        if len(self.words) + len(missing) > CACHED_WORDS:
            self.words.clear()
            missing = met
        self.learn(missing)
        packed = [b"".join(map(self.words.__getitem__, p)) for p in pieces]
        for w in missing:
            if len(w) > SHORT:
                del self.words[w]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def decode(self, ids: pa.Array) -> list[bytes]:
        """Bytes of each array of ids: the batch is one row of tokens, taken in stretches and cut again where the arrays end."""
        flat = ids.flatten().fill_null(-1).to_numpy()
        parts = []
        for at in range(0, len(flat), BATCH_IDS):
            part = flat[at : at + BATCH_IDS]
            self.base.register("batch", pa.table({"place": np.arange(len(part), dtype=np.int32), "id": part}))
            parts.append((self.base.sql(DECODED).fetchall()[0][0] or "").encode("latin-1"))
            self.base.unregister("batch")
        known = (flat >= 0) & (flat < len(self.widths))
        widths = np.where(known, self.widths[np.where(known, flat, 0)], 0)
        ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
        cuts = np.r_[0, np.cumsum(widths)][ends].tolist()
        data = b"".join(parts)
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _runs(numbers: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """``numbers`` in runs whose sizes add up to about ``most``; one that is larger stands alone."""
    return np.split(numbers, np.flatnonzero(np.diff(np.cumsum(sizes[numbers]) // most)) + 1) if len(numbers) else []


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _map_column(df: DataFrame, source: str, target: str, kind: T.DataType, arrow: pa.DataType, sizes: Callable[[pa.Array], pa.Array], most: int, function: Callable[[], Callable[[pa.Array], pa.Array | list]]) -> DataFrame:
    """Replace ``source`` by ``target`` = function(source), in runs of rows that add up to about ``most``; other columns untouched."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (source, target)] + [T.StructField(target, kind)])

    def run(batches):
        apply = function()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            keep = [n for n in batch.schema.names if n not in (source, target)]
            for rows in _runs(np.arange(len(values)), sizes(values).fill_null(0).to_numpy(zero_copy_only=False), most):
                part = slice(int(rows[0]), int(rows[-1]) + 1)
                made = apply(values[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(n)[part] for n in keep), made if isinstance(made, pa.Array) else pa.array(made, arrow)], names=[*keep, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Column ``text`` becomes ``ids``, an array of token ids; ``ranks`` is the path of a rank file."""
    return _map_column(df, text, ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), pc.utf8_length, BATCH_CHARS, lambda: lambda values, e=merges(ranks).encode: e(values.to_pylist()))


def decode(df: DataFrame, ranks: str, ids: str = "ids", data: str = "bytes") -> DataFrame:
    """Column ``ids`` becomes ``data``, the bytes of its tokens in order."""
    return _map_column(df, ids, data, T.BinaryType(), pa.binary(), pc.list_value_length, BATCH_IDS, lambda: merges(ranks).decode)
