"""Alignment of two tokenizers over the same texts by a dangling-suffix transducer.

Side A is a byte-level BPE file, side B a sentencepiece model; both encode a space and the text. The
transducer reads tokens from the side that is behind. Its state is the side that leads and the bytes
of its last token that the other side has not matched yet; an empty residue closes a group. So every
token but the first of a group overlaps the last token of the other side: that is a link. Transitions
are memoised by state and token, groups by their first pair or their tokens, both up to a bound.

No token of either side reaches from a letter over a space, so where a space follows what is not white
space, both sides have a token's end and the transducer stands at the empty residue. A text is cut there
into chunks (a word and the spaces before it, mostly); each is encoded and aligned once, and its groups
and links are remembered up to a bound. Where B's pieces reach over spaces, the whole text is one chunk.

``align`` gives each document its groups and links; ``with_counts`` adds in how many documents of the
whole table each linked pair of ids stands. Documents are dealt into blocks of bounded size, and a
block asks for the count of each of its pairs once, so that a pair that stands in all documents moves
one row a block; no task holds more than a block or the counts of its share of the pairs.

Edge cases: null and empty texts, and texts that either side does not give back byte by byte (such as
ones with U+2581, which B takes for a space), have no tokens: zeros, and an empty string for groups.
Repeated rows and ids are documents of their own. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.bpe import split_words, vocabulary
from newsgraph.tables import materialize

# Characters of text of a block of documents, and its largest number of documents.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 20_000
# Characters that are encoded at once.
RUN_CHARS = 500_000
# Letters from which on a word is long.
LONG_WORD = 1000
# Memoised transitions and groups of a worker.
MOST_STATES, MOST_TRANSITIONS, MOST_GROUPS = 100_000, 1_000_000, 200_000
# Chunks that are remembered from one block to the next, and their characters.
MOST_RUNS, MOST_CHARS = 300_000, 16_000_000
B_BITS = 20
SPACE_SIGN = "▁"
# Spaces and what follows up to the next space that does not follow white space.
_CHUNKS = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")

ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>, block_pairs array<long>, block_docs array<long>"


class Side:
    """Token bytes of one side by id."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.size = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))

    def joined(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level BPE file; special tokens in a text are plain text.

    A compiled encoder serves where ids go by rank; texts with very long words are encoded by our own, in n log n.
    """

    def __init__(self, path: str):
        words = vocabulary(path)
        super().__init__(words.token_bytes)
        self.words, self.compiled = words.words, None
        if words.result == sorted(words.result):
            special = set(words.special.values())
            ranks = {token: i for i, token in enumerate(words.token_bytes) if i not in special}
            self.compiled = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        own = lambda t: np.frombuffer(b"".join(map(self.words.__getitem__, split_words(t))), "<u4").tolist()
        return [self.compiled(" " + t) if self.compiled and max(map(len, t.split()), default=0) < LONG_WORD else own(" " + t) for t in texts]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, which no word reaches over: together, but for those in which a word is long and those whose white space would run on."""
        apart = {i for i, c in enumerate(chunks) if len(c) >= LONG_WORD or c[-1].isspace()} if self.compiled else set(range(len(chunks)))
        alone = dict(zip(sorted(apart), self.encode([chunks[i][1:] for i in sorted(apart)]), strict=True))
        joined = [c for i, c in enumerate(chunks) if i not in apart] if apart else chunks
        ids = self.compiled("".join(joined)) if joined else []
        ends = np.cumsum(self.size[ids]) if ids else np.empty(0, np.int64)
        cuts = np.searchsorted(ends, np.cumsum([len(c.encode("utf-8")) for c in joined])) + 1
        parts = map(ids.__getitem__, map(slice, [0, *cuts.tolist()], cuts.tolist()))
        return [alone[i] if i in apart else next(parts) for i in range(len(chunks))] if apart else list(parts)


class Pieces(Side):
    """A sentencepiece model, which puts the space before the text itself.

    Where no piece reaches from a letter over a space, a text can be encoded chunk by chunk.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = lambda i, name: bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE_SIGN, " ").encode()
        super().__init__([plain(i, name) for i, name in enumerate(names)])
        self.apart = not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", name) for name in names) and SPACE_SIGN in names

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, of which the model puts the first space itself, but for a chunk that is this space alone."""
        found = self.model.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
        return [ids if c != " " or not self.apart else [self.model.piece_to_id(SPACE_SIGN)] for c, ids in zip(chunks, found, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(self.encode_chunks(self.chunks(t)))) for t in texts]

    def chunks(self, text: str) -> list[str]:
        """A space and the text in chunks."""
        return _CHUNKS.findall(" " + text) if self.apart else [" " + text]


class Transducer:
    """Aligns id lists of two sides with equal bytes."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        """States are numbered; 0 is the empty residue, an even number means that A leads."""
        self.number: dict[tuple[bool, bytes], int] = {}
        self.residue: dict[int, bytes] = {0: b""}
        self.next_of: dict[int, int] = {}
        self.closed: set[int] = set()  # pairs that are a group

    def _state(self, a_leads: bool, residue: bytes) -> int:
        if not residue:
            return 0
        found = self.number.get((a_leads, residue))
        if found is None:
            found = self.number[a_leads, residue] = 2 * len(self.number) + (2 if a_leads else 3)
            self.residue[found] = residue
        return found

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that is behind (of A, if none leads)."""
        a_leads = state % 2 == 0 and state != 0
        read = (self.b if a_leads else self.a).token_bytes[token]
        left = self.residue[state]
        if not left:
            found = self._state(True, read)
        elif len(read) <= len(left):
            found = self._state(a_leads, left[len(read) :])
        else:
            found = self._state(not a_leads, read[len(left) :])
        self.next_of[state << B_BITS | token] = found
        return found

    def align(self, a_ids: Iterable[int], b_ids: Iterable[int]) -> list[int | tuple[tuple[int, ...], ...]]:
        """The groups in order: a pair of ids as one number, or where there are more the ids of A, those of B and the links."""
        if len(self.number) > MOST_STATES or len(self.next_of) + len(self.closed) > MOST_TRANSITIONS:
            self._forget()
        next_of, closed = self.next_of.get, self.closed
        groups: list = []
        add = groups.append
        a_rest, b_rest = iter(a_ids), iter(b_ids)
        while True:
            for a, b in zip(a_rest, b_rest, strict=False):
                pair = a << B_BITS | b
                if pair not in closed:
                    break
                add(pair)
            else:
                return groups
            of_a, of_b, links = [a], [b], [pair]
            state = self._step(0, a) if (found := next_of(a)) is None else found
            token = b
            while True:
                key = state << B_BITS | token
                state = self._step(state, token) if (found := next_of(key)) is None else found
                if not state:
                    break
                if state % 2:
                    a = token = next(a_rest)
                    of_a.append(token)
                else:
                    b = token = next(b_rest)
                    of_b.append(token)
                links.append(a << B_BITS | b)
            if len(links) == 1:
                closed.add(pair)
            add((tuple(of_a), tuple(of_b), tuple(links)) if len(links) > 1 else pair)


class _Texts(dict):
    """Groups as text; cleared when full."""

    def __missing__(self, group) -> str:
        pair = isinstance(group, int)
        found = f"{group >> B_BITS}|{group & ((1 << B_BITS) - 1)}" if pair else "|".join(",".join(map(str, side)) for side in group[:2])
        if len(self) >= MOST_GROUPS:
            self.clear()
        self[group] = found
        return found


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Aligner:
    """Both sides, the transducer, and what the groups and chunks met so far say."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        if max(len(self.a.token_bytes), len(self.b.token_bytes)) > 1 << B_BITS:
            raise ValueError(f"a vocabulary has more than {1 << B_BITS} tokens")
        self.transducer = Transducer(self.a, self.b)
        self.texts = _Texts()
        # Chunks are numbered. By number: their groups as text; tokens of A and B, groups, and whether both sides give
        # the chunk back; in how many blocks it was met; and where its linked pairs end, which stand one after the other.
        self.code: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []
        self.numbers, self.met = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        self.links, self.ends = array("q"), array("q", [0])

    def _forget(self) -> None:
        """Chunks that were met in one block only go, and the rarer ones of the others beyond half of what is remembered."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > MOST_RUNS // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: MOST_RUNS // 2]])
        chunks = list(self.code)
        self.code = {chunks[i]: new for new, i in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.code))
        if self.chars > MOST_CHARS // 2:
            kept, self.code, self.chars = kept[:0], {}, 0
        self.shown = [self.shown[i] for i in kept.tolist()]
        self.numbers, self.met = self.numbers[kept], self.met[kept] // 2
        ends = np.array(self.ends, np.int64)
        size = ends[kept + 1] - ends[kept]
        self.links = array("q", np.array(self.links, np.int64)[_places(ends[kept], size)].tobytes())
        self.ends = array("q", np.r_[0, np.cumsum(size)].tobytes())

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that were not met before, and align those that both sides give back, one after the other."""
        a_ids, b_ids = self.a.encode_chunks(chunks), self.b.encode_chunks(chunks)
        data = [c.encode("utf-8") for c in chunks]
        fits = np.ones(len(chunks), bool)
        for side, ids in ((self.a, a_ids), (self.b, b_ids)):
            if side.joined(chain.from_iterable(ids)) != b"".join(data) or not self._ends_alike(side, ids, data):
                fits &= [side.joined(i) == d for i, d in zip(ids, data, strict=True)]
        numbers = np.stack([np.fromiter(map(len, a_ids), np.int64), np.fromiter(map(len, b_ids), np.int64), np.zeros(len(chunks), np.int64), fits], axis=1)
        numbers[~fits] = 0
        of_fit = lambda ids: chain.from_iterable(i for i, fit in zip(ids, fits.tolist(), strict=True) if fit)
        groups = self.transducer.align(of_fit(a_ids), of_fit(b_ids))
        # A chunk's groups are those that end with its last token of A at the latest.
        last = np.r_[0, np.cumsum([1 if g.__class__ is int else len(g[0]) for g in groups])]
        ends = np.searchsorted(last, np.cumsum(numbers[:, 0]))
        numbers[:, 2] = np.diff(ends, prepend=0)
        texts = list(map(self.texts.__getitem__, groups))
        self.shown.extend(";".join(texts[i:j]) for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False))
        # Each token but the first of a group makes a link.
        self.ends.extend((self.ends[-1] + np.cumsum(numbers[:, 0] + numbers[:, 1] - numbers[:, 2])).tolist())
        self.links.extend(chain.from_iterable((g,) if g.__class__ is int else g[2] for g in groups))
        self.code.update(zip(chunks, range(len(self.code), len(self.code) + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))
        self.numbers, self.met = np.concatenate([self.numbers, numbers]), np.r_[self.met, np.zeros(len(chunks), np.int64)]

    @staticmethod
    def _ends_alike(side: Side, ids: list[list[int]], data: list[bytes]) -> bool:
        """Whether the ids of each chunk have as many bytes as it."""
        ends = np.r_[0, np.cumsum(side.size[np.fromiter(chain.from_iterable(ids), np.int64)])][np.cumsum([len(i) for i in ids])]
        return bool((ends == np.cumsum([len(d) for d in data])).all())

    def _codes(self, texts: list[str]) -> list[list[int]]:
        """The chunks of each text by number; none where a side does not give the text back."""
        out, start, chars = [], 0, 0
        for at, text in enumerate(texts):
            chars += len(text)
            if chars < RUN_CHARS and at + 1 < len(texts):
                continue
            pieces = [self.b.chunks(t) if t else [] for t in texts[start : at + 1]]
            if new := list(set().union(*pieces) - self.code.keys()):
                self._learn(new)
            out.extend(list(map(self.code.__getitem__, p)) for p in pieces)
            start, chars = at + 1, 0
        lost = set(np.flatnonzero(self.numbers[:, 3] == 0).tolist())
        if lost:
            out = [[] if not lost.isdisjoint(c) else c for c in out]
        return out

    def block(self, number: int, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
        """Aligned documents of one block; its first row holds the pairs of the whole block and the number of its documents with each."""
        if len(self.code) > MOST_RUNS or self.chars > MOST_CHARS:
            self._forget()
        n = len(doc_ids)
        of_doc = self._codes([t or "" for t in texts])
        codes = np.fromiter(chain.from_iterable(of_doc), np.int64)
        last = np.r_[0, np.fromiter(accumulate(map(len, of_doc)), np.int64, n)]
        self.met[np.unique(codes)] += 1
        numbers = self.numbers[codes, :3]
        n_a, n_b, n_groups = np.diff(np.r_[np.zeros((1, 3), np.int64), np.cumsum(numbers, axis=0)][last], axis=0).T

        # The linked pairs of each document, in order, and how often each is linked.
        ends = np.array(self.ends, np.int64)
        size = ends[codes + 1] - ends[codes]
        doc = np.repeat(np.repeat(np.arange(n), np.diff(last)), size)
        linked = np.sort(doc << 2 * B_BITS | np.array(self.links, np.int64)[_places(ends[codes], size)])
        first = np.flatnonzero(np.r_[True, linked[1:] != linked[:-1]][: len(linked)])
        times = np.diff(np.r_[first, len(linked)]).astype(np.int32)
        pairs = linked[first] & ((1 << 2 * B_BITS) - 1)
        offsets = pa.array(np.searchsorted(linked[first] >> 2 * B_BITS, np.arange(n + 1)).astype(np.int32))
        in_docs = np.unique(pairs, return_counts=True)

        once = lambda values: pa.array([values, *[None] * (n - 1)][:n], pa.list_(pa.int64()))
        columns = [np.full(n, number), pa.array(doc_ids, pa.int64()), n_a, n_b, n_groups, n_a + n_b - n_groups]
        columns += [pa.array([";".join(map(self.shown.__getitem__, c)) for c in of_doc], pa.string())]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pairs, times)]
        columns += [once(in_docs[0]), once(in_docs[1].astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[f.split()[0] for f in ALIGNED.split(", ")])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents (doc_id, text) to rows of ``ALIGNED``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B by group. ``pairs`` are the distinct linked pairs
    (A's id shifted left by 20 bits, or B's id) and ``times`` how often each is linked.
    """

    def run(batches):
        to = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            start = chars = 0
            for at, text in enumerate(texts):
                chars += len(text or "")
                if chars >= BLOCK_CHARS or at + 1 - start >= BLOCK_DOCS or at + 1 == len(texts):
                    yield to.block(block, ids[start : at + 1], texts[start : at + 1])
                    block, start, chars = block + 1, at + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: the number of documents with each linked pair, and whether no pair of the same A id has more."""
    each = aligned.filter("block_pairs IS NOT NULL").select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("p"))
    counts = each.groupBy(F.col("p.block_pairs").alias("pair")).agg(F.sum("p.block_docs").alias("count")).withColumn("a", F.shiftright("pair", B_BITS))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of the documents of one block."""
    pairs, count, best = (answers.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pairs)
    pairs, count, best = pairs[order], count[order], best[order].astype(np.int64)
    lists = docs.column("pairs").combine_chunks()
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    times = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    sums = lambda values: np.diff(np.r_[0, np.cumsum(values)][ends])
    kept = docs.drop_columns(["block", "pairs", "times"])
    return kept.append_column("n_best", pa.array(sums(times * best[at] if len(at) else times), pa.int64())).append_column("count_sum", pa.array(sums(times * count[at] if len(at) else times), pa.int64()))


def with_counts(aligned: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` of a written table of ``align``.

    ``n_best`` are a document's links whose pair stands in as many documents as any pair of its A id;
    ``count_sum`` adds the number of documents of the pair over all its links.
    """
    asked = aligned.filter("block_pairs IS NOT NULL").select(F.col("block").alias("of_block"), F.explode("block_pairs").alias("pair"))
    answers = asked.join(pair_counts(aligned), "pair").select("of_block", "pair", "count", "best")
    kept = [f.name for f in aligned.schema if f.name not in ("block_pairs", "block_docs")]
    docs = aligned.select(*kept)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.drop("block", "pairs", "times").schema)
    return docs.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_score, f"{out}, n_best long, count_sum long")


def aligned_table(docs: DataFrame, a_path: str, b_path: str, *digests) -> DataFrame:
    """``align`` written to the shared folder; ``digests`` are columns of ``groups`` that are kept in its place."""
    found = align(docs, a_path, b_path)
    return materialize(found.select(*[c for c in found.columns if c != "groups"], *(digests or ["groups"])), "aligned", "zstd")
