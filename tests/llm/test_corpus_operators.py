"""The corpus operators against plain versions, exact round trips and held-out labels."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsgraph.llm import bpe, exact_search, graph_search, licences, mixing, near_duplicates, pii, queries, toxicity, training_order, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string"
LONG = "word " * 30_000 + "x" * 20_000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", "clash") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    return frame(spark, [(1, None, "a"), (2, "", "a"), (3, LONG, None), (4, " \t\n", "b"), (5, "same text here", "b"), (5, "same text here", "b"), (6, "same text here", "b"), (None, "no id", "a")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


TEXTS = [
    "", "a<|endoftext|>b<|endoftext|>", "don't I'LL 's we've", "  \n\n  x\t\t y ", "x" * 5000, "ab" * 3000 + "é" * 500,
    "😀" * 400 + "漢字" * 100, "\x1c\x1d a\u0085b​   　 c", "1²³½٣", "\U000105c0\U00016d70aᲉ",
]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(rows, PATH).withColumn("kept", F.col("ids")), PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bytes(got[i]["kept"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert got[i]["text"] == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_long_words_merge_like_short_ones():
    words = bpe.vocabulary(PATH)
    draw = random.Random(3)
    for _ in range(50):
        word = bytes(draw.choice(b"abethinrs ") for _ in range(draw.randint(2, 200)))
        parts = [words.byte_id[b] for b in word]
        assert words._merge_short(list(parts)) == words._merge_long(list(parts))


def test_bpe_odd_rows(odd, empty):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == 8 and [len(r["ids"]) for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert bpe.encode(empty, PATH).count() == 0


def brute_classes(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups, most):
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(3, 150))]
        for _ in range(draw.randint(1, most)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("together", [256, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, together):
    """With clusters resolved in one task, and dealt by rare shingles."""
    monkeypatch.setattr(near_duplicates, "TOGETHER", together)
    monkeypatch.setattr(near_duplicates, "CENTRES", 1)
    monkeypatch.setattr(near_duplicates, "GROWTH", 2)
    rows = near_copies(5, 12, 12)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    expected = brute_classes(rows, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5)]
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_licences_equal_a_plain_scan():
    texts = ["MIT License mit license cc by by cc", "under the\nGNU General-Public LICENSE, v2", "apache licenses", "éapache license", "", None]
    for text in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in licences.BASE.items():
            parts = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(parts)] == parts:
                    places.append(i)
                    labels.add(label)
        expected = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert licences.scan_text(text)[:5] == expected


def test_licence_expressions():
    assert licences.to_postfix("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert licences.evaluate(licences.to_postfix("(MIT OR GPL-3.0-only) AND BSD-3-Clause")) == ({"mit", "gpl-3.0", "bsd"}, True)
    assert licences.evaluate(licences.to_postfix("MIT AND GPL-3.0-only"))[1] is False
    for broken in ("", "AND MIT", "(MIT", "MIT)", "MIT OR"):
        assert licences.to_postfix(broken) is None
    assert licences.scan_text("# SPDX-License-Identifier: MIT OR GPL-2.0-only")[5:7] == ("gpl-2.0,mit", True)


def test_licences_odd_rows(odd, empty):
    rows = licences.scan(odd).collect()
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 4)} == {0} and all(r["score"] == 0 for r in rows)
    assert licences.scan(empty).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, v string")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist(), 0, "clash", "clash") for i in range(40)]
    rows += [(100 + i, [1.0] * 8, 0, "", "") for i in range(30)]
    rows += [(200, None, 0, "", ""), (201, [0.0] * 8, 0, "", ""), (202, [float("nan")] * 8, 0, "", ""), (203, [None] * 8, 0, "", ""), (204, [float("inf")] * 8, 0, "", ""), (205, [1.0, 2.0], 0, "", ""), (None, [1.0] * 8, 0, "", "")]
    return vectors(spark, rows)


def test_exact_top_k_equals_brute_force(odd_vectors, empty, spark):
    got = exact_search.exact_top_k(odd_vectors, F.col("vec_id") % 10 == 0, k=5).collect()
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in odd_vectors.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    expected = set()
    for q, a in rows:
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))
            expected |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected
    assert exact_search.exact_top_k(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_exact_top_k_prunes_without_loss():
    draw = np.random.default_rng(4)
    ids, weights = np.arange(2000, dtype=np.int64), np.floor(256 * draw.normal(size=(2000, 6)))
    found, scores = exact_search.top_of_shard(ids[:20], weights[:20], ids, weights, 5)
    plain = (weights[:20] @ weights.T).astype(np.int64)
    plain[np.arange(20), np.arange(20)] = -(1 << 60)
    for q in range(20):
        order = np.lexsort((ids, -plain[q]))[:5]
        assert found[q].tolist() == ids[order].tolist() and scores[q].tolist() == plain[q][order].tolist()


def test_graph_search_recall(spark, odd_vectors):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(3000, 32))
    _, _, arrays = graph_search.build_graph(np.arange(3000), x)
    order, _, _ = graph_search.build_graph(np.arange(3000), x)
    norms = (x**2).sum(axis=1)
    found, _ = graph_search.search_graph(x[:200], x[order], arrays)
    plain = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    recall = np.mean([len(set(order[f[:20]]) & set(p)) / 20 for f, p in zip(found, plain, strict=True)])
    assert recall >= 0.9 and norms.max() > 1
    got = graph_search.nearest(odd_vectors, F.col("vec_id") % 10 == 0, k=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
        assert r["vec_id"] != r["query_id"] and r["vec_id"] < 200
    # Thirty copies tie: the smallest other ids come first.
    assert by[110][:19] == [100 + i for i in range(20) if i != 10] and set(by) == {0, 10, 20, 30, 100, 110, 120}
    assert graph_search.nearest(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_nearest_query_recall(spark, monkeypatch, shard_rows):
    """The registered query against brute force over all rows, with one shard and with several."""
    monkeypatch.setattr(graph_search, "SHARD_ROWS", shard_rows)
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got = defaultdict(list)
    for r in queries.op4_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        assert math.isclose(r["score"], float(rows[r["query_id"]] @ rows[r["vec_id"]]), rel_tol=1e-9) and r["vec_id"] != r["query_id"]
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in (wanted := ids[ids % 20 == 0]).tolist():
        scores = x @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        hits += len(set(best) & set(got[q]))
    assert hits >= 0.9 * 20 * len(wanted) and set(got) == set(wanted.tolist())


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(toxicity.sample(docs, labels, ~held))
    scored = toxicity.score(docs.join(labels, "doc_id").filter(held), model).select("toxic", "score").collect()
    toxic, clean = [r["score"] for r in scored if r["toxic"]], [r["score"] for r in scored if not r["toxic"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc >= 0.95 and np.mean(np.array(clean) < 0.5) >= 0.98 and np.mean(np.array(toxic) >= 0.5) >= 0.8


def test_toxicity_equals_a_plain_version(spark):
    """Presence vectors, ratios and scores by dictionaries."""
    rows = [("you vile rotten pest", 1), ("what a lovely garden day", 0), ("vile pest again", 1), ("a lovely walk", 0)] * 6
    model = toxicity.fit(rows)
    held = dict(zip(model.buckets.tolist(), zip(model.ratios.tolist(), model.weights.tolist(), strict=True), strict=True))
    grams = lambda t: set(toxicity.ngram_buckets(t).tolist())
    ones, zeros = [grams(t) for t, y in rows if y], [grams(t) for t, y in rows if not y]
    for b, (ratio, _) in held.items():
        p, q = sum(b in g for g in ones), sum(b in g for g in zeros)
        assert math.isclose(ratio, math.log((p + 1) / 14) - math.log((q + 1) / 14))
    texts = ["vile garden", "lovely pest, vile", "nothing known 123", "", None]
    for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect():
        found = [held[b] for b in grams(r["text"]) & set(held)]
        margin = sum(a * w for a, w in found) / (math.sqrt(sum(a * a for a, _ in found)) + 1) + model.bias
        expected = 1 / (1 + math.exp(-margin))
        assert math.isclose(r["score"], expected if found else min(expected, toxicity.NO_EVIDENCE))


def test_toxicity_odd_rows(odd, empty):
    for rows in ([], [("a", 1)], [("good day", 0), ("bad day", 1)] * 10):
        model = toxicity.fit(rows)
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    balanced = toxicity.fit([("good day", 0), ("bad day", 1)] * 10)
    assert all(r["score"] < 0.5 for r in toxicity.score(odd.filter("coalesce(trim(text), '') = ''"), balanced).collect())
    assert toxicity.score(empty, toxicity.fit([])).count() == 0


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and doubled % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_equal_plain_patterns():
    draw = random.Random(11)
    pieces = ["a.b@c-d.example.com", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "é", " ", "  ", ".", "-", "12", "\n", "007.1.1.1", "+49.30"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 8)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_field_finds_method_kinds(spark, odd, empty):
    rows = spark.createDataFrame([(1, 'see Mr. Karl Huber there, token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" and a.b@c.example.com'), (2, "Nothing of The Kind In Here.")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(rows).collect()}
    text = rows.first()["text"]
    assert [(k, text[a:b]) for k, a, b in found[1]] == [("email", "a.b@c.example.com"), ("name", "Karl Huber"), ("secret", "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c")] and found[2] == []
    assert "[EMAIL]" in pii.redacted(rows).filter("doc_id = 1").first()["text"]
    assert all(r["spans"] == [] for r in pii.find(odd).collect()) and pii.find(empty).count() == 0
    assert [r["text"] for r in pii.redacted(odd).filter("doc_id IN (1, 2)").collect()] == [None, ""]


def test_pii_lines_without_doubt_decode_to_nothing():
    field = pii.field()
    of = pii._Classes(field)
    draw = random.Random(5)
    words = ["the", "Mr.", "Anna", "token", "=", "123-45-6789", '"a8Zx91Qw7Lm2Rt5Y"', "passport", "number", "X1234567", "Das", "|", "ab%%%"]
    lines = [np.array([of[draw.choice(words)] for _ in range(draw.randint(1, 12))], np.int32) for _ in range(800)]
    for line, labels in zip(lines, field.decode(lines), strict=True):
        assert len(field.doubtful(np.concatenate([[0], line, [0]]))) or not labels.any()


def test_mixing_meets_targets(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mixing.mix(mixing.measure(docs)).select("doc_id", "source", "size", "source_size", "target", "draws").collect()
    by = defaultdict(list)
    for r in mixed:
        taken = sum(d["words"] for d in r["draws"])
        assert taken <= 3 * r["size"] and all(d["words"] <= r["size"] for d in r["draws"])
        by[r["source"]].append((r["size"], r["target"], r["source_size"], taken))
    for rows in by.values():
        assert sum(s for s, *_ in rows) == rows[0][2] and abs(sum(t for *_, t in rows) - rows[0][1]) <= 1
    again = mixing.mix(mixing.measure(docs.repartition(7))).select("doc_id", "draws").collect()
    assert {r["doc_id"]: r["draws"] for r in again} == {r["doc_id"]: r["draws"] for r in mixed}
    assert mixing.mix(mixing.measure(odd)).count() == 8 and mixing.mix(mixing.measure(empty)).count() == 0
    out = mixing.shards(mixing.mix(mixing.measure(odd)))
    assert out.filter("doc_id IS NULL OR doc_id > 2").count() > 0 and out.filter("size = 0").count() == 3


def test_mixing_targets_and_tree():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == [96.0, 3.0, 3.0]
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    split = mixing.split_quotas([7, 0, 30, 5], 6)
    assert split.sum(axis=0).tolist() == [7, 0, 30, 5] and split.sum(axis=1).tolist() == [7] * 6


def test_mixing_shards_follow_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "BLOCKS_PER_SHARD", 8)
    mixed = mixing.mix(mixing.measure(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source"))).collect()
    sizes = defaultdict(int)
    for r in mixed:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    shard_of, drawn = {}, defaultdict(set)
    for r in mixed:
        block = r["mix_key"] % max(1, -(-sizes[r["source"]] // 64))
        for d in r["draws"]:
            if d["words"]:
                # A block goes to one shard in each pass.
                assert shard_of.setdefault((r["source"], block, d["pass"]), d["shard"]) == d["shard"]
                drawn[r["source"], d["shard"]].add((block, d["pass"]))
    quotas = [sum(len(v) for (n, _), v in drawn.items() if n == name) for name in names]
    shards = max(1, sum(quotas) // 8)
    tree = mixing.split_quotas(quotas, shards)
    assert shards > 3 and all(len(drawn[name, k]) == tree[k, i] for i, name in enumerate(names) for k in range(shards))
    whole = [(r["doc_id"], r["text"]) for r in mixing.shards(spark.createDataFrame(mixed)).collect()]
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert all(texts[i] == t for i, t in whole) and len(whole) == sum(len(r["draws"]) for r in mixed)


def test_warc_round_trip(spark):
    pages = [(1, "http://www.a.example.com/x?q=1", "<p>one</p>"), (2, "http://b.example.com/", "<p>one</p>"), (3, None, None), (4, "not a url", ""), (5, "https://a.example.com:8080/y z", "é" * 50_000), (5, "https://a.example.com:8080/y z", "é" * 50_000)]
    rows = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string")
    archives = warc.write_archives(rows)
    blocks, directory = warc.write_index(archives)
    got = warc.read_records(warc.lookup(rows.select("url"), blocks, directory), archives).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    expected = [(1, 10, digest("<p>one</p>"), "revisit", 2), (2, 10, digest("<p>one</p>"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None)] + [(5, 100_000, digest("é" * 50_000), "response", None)] * 2
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(expected, key=lambda r: r[:4])
    hits = warc.lookup(spark.createDataFrame([("http://b.example.com/",), ("http://nowhere.example.com/",)], "url string"), blocks, directory)
    assert [(r["url"], r["page_id"]) for r in hits.collect()] == [("http://b.example.com/", 2)]
    assert [bytes(r["payload"]) for r in warc.read_records(hits, archives).collect()] == [b"<p>one</p>"]
    assert warc.reversed_host_key("https://www.A.Example.com/p?q") == "com,example,a)/p?q"
    none = warc.write_archives(rows.limit(0))
    assert warc.read_records(warc.lookup(rows.select("url"), *warc.write_index(none)), none).count() == 0


def test_warc_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "RANGE_LINES", 20)
    rows = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i // 3}", str(i)) for i in range(300)], "page_id long, url string, html string")
    archives = warc.write_archives(rows)
    blocks, directory = warc.write_index(archives)
    hits = warc.lookup(rows.filter("page_id % 5 = 0").select("url"), blocks, directory)
    wanted = {r["url"] for r in rows.filter("page_id % 5 = 0").collect()}
    assert sorted(r["page_id"] for r in hits.collect()) == sorted(r["page_id"] for r in rows.collect() if r["url"] in wanted)


def test_training_order(spark, odd, empty):
    for total in (1, 2, 3, 5, 1000, 4097):
        assert sorted(training_order.slots_of(np.arange(total), total).tolist()) == list(range(total))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id IS NULL"))
    shards = training_order.write_shards(docs, PATH)
    rows = training_order.read_from(shards).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    words, parts = bpe.vocabulary(PATH), defaultdict(dict)
    for r in rows:
        parts[r["doc_id"]][r["number"]] = bytes(r["ids"])
    for r in docs.collect():
        ids = np.concatenate([np.frombuffer(words.encode(r["text"] or ""), "<u4").astype("<u2"), [50256]]).astype("<u2")
        assert b"".join(parts[r["doc_id"]][i] for i in range(len(parts[r["doc_id"]]))) == ids.tobytes()
    late = training_order.read_from(shards, 300).collect()
    assert sorted(r["slot"] for r in late) == list(range(300, len(rows)))
    assert training_order.read_from(training_order.write_shards(empty, PATH)).count() == 0
    assert training_order.read_from(training_order.write_shards(odd, PATH)).select("doc_id").distinct().count() == 7


def test_training_order_is_the_same_under_another_partitioning(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    order = lambda d: sorted((r["slot"], r["doc_id"], r["number"], r["crc32"]) for r in training_order.read_from(training_order.write_shards(d, PATH)).collect())
    plain = order(docs.coalesce(1))
    monkeypatch.setattr(training_order, "PART_ROWS", 16)
    monkeypatch.setattr(training_order, "BUCKET_ROWS", 32)
    monkeypatch.setattr(training_order, "NUMBER_ROWS", 50)
    assert order(docs.repartition(7)) == plain


def test_training_order_encoder_equals_the_own_one():
    words, encode = bpe.vocabulary(PATH), training_order.encoder(PATH)
    for text in [*TEXTS, LONG, None]:
        assert encode(text).tolist() == [*np.frombuffer(words.encode(text or ""), "<u4").tolist(), 50256]


def test_recall_on_vectors_of_unequal_length(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in graph_search.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.mean([len(got[20 * q] & set(b.tolist())) / 20 for q, b in enumerate(best)]) >= 0.95


def test_a_first_bound_loses_no_result(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "SHARD_ROWS", 50)
    monkeypatch.setattr(exact_search, "FIRST_ROWS", 8)
    draw = np.random.default_rng(6)
    x = draw.integers(-3, 4, (400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x / 256)] + [(1000 + i, [0.01] * 3) for i in range(7)] + [(2000, [])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_search.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()}
    for q in range(0, 400, 10):
        plain = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in plain]
    assert [got[1000, n][0] for n in range(1, 6)] == [1001, 1002, 1003, 1004, 1005] and (2000, 1) not in got
