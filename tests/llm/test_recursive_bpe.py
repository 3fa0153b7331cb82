"""Recursive byte-pair merges against the public library."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from newsgraph.llm import recursive_bpe
from newsgraph.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return recursive_bpe.merges(PATH)


def texts():
    draw = random.Random(5)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    plain = ["", " ", "\n\n \t x", "don't I'LL", "a<|endoftext|>b", "\0 a\0b", "1²³½٣", "😀" * 300, "漢字が混ざった文章" * 100, "x" * 20_000, "ab" * 3000]
    hard = [some("abc éß", n) for n in range(1, 120)] + [some("abcde", n) for n in range(60, 200, 3)] + [some("abcdefghijkl", 4000)]
    return plain + hard + ["".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(800))]


def test_ids_and_bytes_equal_the_library(library, merges):
    given = texts()
    got = merges.encode(given).to_pylist()
    assert got == [library.encode_ordinary(t) for t in given]
    assert merges.decode(pa.array(got, pa.list_(pa.int32()))) == [t.encode() for t in given]


def test_every_character_is_split_as_in_the_library(library, merges):
    for start in range(0, 0x110000, 0x8000):
        if 0xD800 <= start < 0xE000:
            continue
        text = "\n".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(start, start + 0x8000, 7) if not 0xD800 <= c < 0xE000)
        assert merges.encode([text]).to_pylist()[0] == library.encode_ordinary(text)


def test_bounds_change_nothing(library, merges, monkeypatch):
    given = texts()
    expected = [library.encode_ordinary(t) for t in given]
    for name, value in (("START_ROWS", 500), ("ALL_ROWS", 4000), ("CACHED_WORDS", 10), ("BATCH_IDS", 700)):
        monkeypatch.setattr(recursive_bpe, name, value)
    merges.words.clear()
    assert merges.encode(given).to_pylist() == expected
    assert merges.decode(pa.array(expected, pa.list_(pa.int32()))) == [t.encode() for t in given]
    assert len(merges.words) <= len({w for t in given for w in recursive_bpe.split_words(t)})


def test_odd_rows(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 30_000, "c"), (3, "same", "d"), (3, "same", "d"), (None, " \n", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(recursive_bpe.encode(df, PATH).collect(), key=str)
    expected = [(i, library.encode_ordinary(t or "")) for i, t, _ in rows]
    assert [c for c in recursive_bpe.encode(df, PATH).columns] == ["doc_id", "ids"]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(expected, key=str)
    back = spark.createDataFrame([(1, None), (2, []), (3, [64, None, -5, 10**6]), (4, [64, 65])], "id int, ids array<int>")
    assert {r["id"]: bytes(r["bytes"]) for r in recursive_bpe.decode(back, PATH).collect()} == {1: b"", 2: b"", 3: library.decode_bytes([64]), 4: library.decode_bytes([64, 65])}
    assert recursive_bpe.decode(recursive_bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op11_recursive_bpe"](spark, DATA).collect()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(documents)
    for d in documents:
        ids, text = library.encode_ordinary(d["text"] or ""), (d["text"] or "").encode()
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
