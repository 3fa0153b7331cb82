"""Alignment of two tokenizers against byte offsets, and its counts against a plain count."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsgraph.llm import alignment
from newsgraph.llm.bpe import byte_alphabet
from newsgraph.llm.queries import PIECES, QUERIES, TOKENIZER

DATA = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(libraries, texts):
    """The contract by byte offsets: per text [n_a, n_b, n_groups, n_links, n_best, count_sum, groups]."""
    a, b = libraries
    back = {c: x for x, c in byte_alphabet().items()}
    a_bytes = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    rows, links_of = [], []
    for text in texts:
        sides = []
        if text:
            for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)):
                spans, at = [], 0
                for i in ids:
                    spans.append((at, at + len(of(i)), i))
                    at += len(of(i))
                sides.append((spans, b"".join(map(of, ids))))
        if not text or any(data != (" " + text).encode() for _, data in sides):
            rows.append([0] * 6 + [""])
            links_of.append([])
            continue
        (x, _), (y, _) = sides
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, _, i in side if start <= s < end) for side in (x, y)))
            start = end
        links, j = [], 0
        for s, e, i in x:
            while y[j][1] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][0] < e:
                links.append((i, y[k][2]))
                k += 1
        rows.append([len(x), len(y), len(groups), len(links), 0, 0, ";".join(groups)])
        links_of.append(links)
    count = Counter(pair for links in links_of for pair in set(links))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    for row, links in zip(rows, links_of, strict=True):
        row[4] = sum(count[p] == most[p[0]] for p in links)
        row[5] = sum(count[p] for p in links)
    return rows


def texts():
    draw = random.Random(7)
    odd = [None, "", " ", "\n", "a", "a▁b", "<|endoftext|> <s> <0x41>", "  two  spaces ", "é漢😀\0x", "x" * 3000, "word " * 20_000]
    return odd + ["".join(draw.choice("abcdef ghé漢.,1 \n") for _ in range(draw.randint(1, 400))) for _ in range(60)] + ["same text"] * 3


def test_alignment_equals_offsets(spark, libraries, monkeypatch):
    given = texts()
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(given)], "doc_id long, text string, groups string, block int").repartition(3)
    got = {r["doc_id"]: r for r in alignment.with_counts(alignment.aligned_table(docs, TOKENIZER, PIECES)).collect()}
    expected = plain(libraries, given)
    assert sorted(got) == list(range(len(given)))
    for i, row in enumerate(expected):
        assert [got[i][c] for c in [*COLUMNS, "groups"]] == row, given[i]


def test_runs_equal_whole_texts(libraries):
    side = alignment.Pieces(PIECES)
    given = [t for t in texts() if t] + [" ", "   ", "a ", " a  ", "\n \n", "a\u3000b \u00a0c", "e \u0301 \u0308x"]
    assert side.apart and side.encode(given) == [libraries[1].encode(t) for t in given]


def test_bounds_change_nothing(libraries, monkeypatch):
    given = [t for t in texts() if t and len(t) < 1000]
    aligner = alignment.Aligner(TOKENIZER, PIECES)
    whole = aligner.block(0, list(range(len(given))), given).to_pylist()
    for name, value in (("MOST_STATES", 3), ("MOST_TRANSITIONS", 5), ("MOST_GROUPS", 2), ("MOST_RUNS", 4), ("RUN_CHARS", 300)):
        monkeypatch.setattr(alignment, name, value)
    again = alignment.Aligner(TOKENIZER, PIECES).block(0, list(range(len(given))), given).to_pylist()
    key = lambda r: (r["doc_id"], r["groups"], sorted(zip(r["pairs"], r["times"], strict=True)), sorted(zip(r["block_pairs"] or [], r["block_docs"] or [], strict=True)))
    assert list(map(key, whole)) == list(map(key, again))


def test_pairs_over_blocks_and_odd_ids(spark, libraries, monkeypatch):
    rows = [(5, "same text"), (5, "same text"), (None, "same text"), (None, None), (6, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = alignment.with_counts(alignment.aligned_table(docs, TOKENIZER, PIECES)).collect()
    expected = [(i, *row) for (i, _), row in zip(rows, plain(libraries, [t for _, t in rows]), strict=True)]
    assert sorted(((r["doc_id"], *(r[c] for c in [*COLUMNS, "groups"])) for r in got), key=str) == sorted(expected, key=str)
    assert alignment.with_counts(alignment.aligned_table(docs.limit(0), TOKENIZER, PIECES)).count() == 0


def test_query(spark, libraries):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_alignment"](spark, DATA).collect()}
    assert len(got) == len(documents)
    for d, row in zip(documents, plain(libraries, [d["text"] for d in documents]), strict=True):
        r = got[d["doc_id"]]
        assert [r[c] for c in COLUMNS] == row[:6] and r["groups_sha256"] == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")


def test_chunks_are_aligned_once(libraries, monkeypatch):
    """A word that stands in every document is encoded and aligned once, and forgetting the rare ones between blocks changes nothing."""
    draw = random.Random(3)
    common = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    odd = ["x\n", "\ty", "z.　", "é ", "1,5", "", "", "漢字", "w" * 1500, "v\x1c", "it's", "a\n\n", "😀"]
    blocks = [[" ".join(draw.choice(common * 3 + odd) for _ in range(60)) + draw.choice(("", " ", "\n")) for _ in range(20)] + [None, "a▁b", " "] for _ in range(4)]
    expected = plain(libraries, [t for texts in blocks for t in texts])
    for bound in (alignment.MOST_RUNS, 60):
        monkeypatch.setattr(alignment, "MOST_RUNS", bound)
        read = []
        aligner = alignment.Aligner(TOKENIZER, PIECES)
        align = aligner.transducer.align
        monkeypatch.setattr(aligner.transducer, "align", lambda a, b, align=align, read=read: align(read.append(a := list(a)) or a, b))
        rows = [r for n, texts in enumerate(blocks) for r in aligner.block(n, list(range(len(texts))), texts).to_pylist()]
        for r, row in zip(rows, expected, strict=True):
            assert [r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]] == [*row[:4], row[6]]
            assert sum(r["times"]) == r["n_links"] and len(set(r["pairs"])) == len(r["pairs"])
        assert sum(map(len, read)) < sum(r["n_a"] for r in rows) / 3
