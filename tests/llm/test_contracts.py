"""Registered queries whose columns SQL can't express, against plain Python on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_corpus_operators import plain_spans
from tokenizers import Tokenizer

from newsgraph.llm import mixing
from newsgraph.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def by_doc(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF_DIR).collect()}


def test_bpe(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = by_doc(spark, "op2_bpe")
    assert set(got) == set(documents)
    for i, d in documents.items():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_licences(spark, documents):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = by_doc(spark, "op3_licences")
    assert set(got) == set(documents)
    for i, d in documents.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(at, label) for phrase, label in phrases.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        ends = (min(places)[0], max(places)[0]) if places else (None, None)
        r, labels = got[i], ",".join(sorted({label for _, label in places}))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), *ends, labels)
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_personal_data(spark, documents):
    got = by_doc(spark, "op8_pii")
    assert set(got) == set(documents)
    for i, d in documents.items():
        spans = plain_spans(d["text"] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts and r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_toxicity(spark, documents):
    got = by_doc(spark, "op5_toxicity")
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_mixing(spark, documents):
    got = by_doc(spark, "op10_mixing")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in documents.items()}
    of_source = defaultdict(int)
    for i, d in documents.items():
        of_source[d["source"]] += size[i]
    names = sorted(of_source, key=lambda n: (n is None, n or ""))
    aims = dict(zip(names, mixing.targets([of_source[n] for n in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for i, r in got.items():
        source = documents[i]["source"]
        assert (r["size"], r["source_size"]) == (size[i], of_source[source]) and abs(r["target"] - aims[source]) < 1e-6 and 0 <= r["taken"] <= 3 * size[i]
        assert sum(int(part.split(":")[1]) for part in filter(None, r["shards"].split(","))) == r["taken"]
        taken[source] += r["taken"]
    assert set(got) == set(documents) and all(abs(taken[n] - aims[n]) <= 1 for n in names)
