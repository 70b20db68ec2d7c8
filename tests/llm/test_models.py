"""Tokens, packing, shards, licences and the two classifiers."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetwin.llm import bpe, langid, licenses, packing, quality, shards

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = " \n\t\r\x1c\x85 'sdtreABcé中文é123!?.,😀​"
TEXTS = [None, "", " ", "a", "Hello world, it's fine.\nNew line. ", "  two  spaces\n\n", "ab" * 3000, "x<|endoftext|>y", "ß Ünï 東京 😀😀"]


@pytest.fixture(scope="module")
def ranks():
    with open(MULTI, "rb") as f:
        return bpe.load_ranks(f.read())


def naive(piece, ranks):
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merging_equals_the_naive_way(ranks):
    rng = random.Random(2)
    for _ in range(400):
        piece = "".join(rng.choice("etaoin shé") for _ in range(rng.randint(1, 30))).encode()
        if piece not in ranks:
            assert bpe.merge_piece(piece, ranks) == naive(piece, ranks)


def test_codec_equals_the_library(ranks):
    own = bpe.Codec(ranks, P.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, np.uint32).tolist() == lib.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


def test_bpe_of_documents(docs, ranks):
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = docs(TEXTS).withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r for r in bpe.digest_documents(rows, MULTI, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs([]).where("false"), MULTI, P.PATTERN).count() == 0
    full = bpe.encode_documents(docs([(None, "a b")]), MULTI, P.PATTERN).first()
    assert bytes(full["decoded"]) == b"a b"


def packed(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))]
        assert sum(r["length"] for r in s) <= packing.LENGTH
    return by


def test_packing_of_odd_texts(docs, prose):
    texts = [*TEXTS, prose(1, 3000), *(prose(k, 100 + 37 * k) for k in range(30))]
    t = Tokenizer.from_file(PLAIN)
    rows = packing.pack_documents(docs(texts).withColumn("group", F.lit(0)), PLAIN).collect()
    total = 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [(r["start"], r["length"]) for r in mine] == packing.pieces(len(ids))
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += len(ids)
    assert len(packed(rows)) <= 1.05 * -(-total // packing.LENGTH) + 1
    assert packing.pack_documents(docs([]).where("false"), PLAIN).count() == 0


def test_pieces():
    assert packing.pieces(1) == [(0, 1)] and packing.pieces(2048) == [(0, 2048)]
    assert packing.pieces(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.pieces(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("open_bins", [1, 3, 100])
def test_packer_is_best_fit_in_bounded_space(open_bins):
    rng = random.Random(6)
    p, bins, closed = packing.Packer(100, open_bins), {}, set()
    for _ in range(2000):
        n = rng.randint(1, 100)
        opened = {b: f for b, f in bins.items() if b not in closed and f}
        at, off = p.put(n)
        fits = [f for f in opened.values() if f >= n]
        if fits:
            assert opened[at] == min(fits)
        else:
            assert at not in bins
            if len(opened) >= open_bins:
                low = min(opened.values())
                gone = [b for b, f in opened.items() if f == low]
                closed.add(next(b for b in gone if b not in p.stacks[low]))
        assert off == 100 - bins.get(at, 100)
        bins[at] = bins.get(at, 100) - n
        assert p.count <= open_bins


def test_shards_of_odd_texts(docs, prose):
    texts = [None, "", *["copy of one text " * 20] * 400, *(prose(k, 20 + k % 300) for k in range(800)), prose(5, 2000)]
    rows = shards.shard_documents(docs([*enumerate(texts), (None, "x"), (None, "x")]).withColumn("cell", F.lit(1)).withColumn("part", F.lit(1))).collect()
    assert len(rows) == len(texts) + 2
    load, slots = np.zeros(shards.SHARDS), {}
    for r in rows:
        t = "x" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == shards.SHARDS
    assert load.max() <= 1.05 * load.mean()
    again = {(r["doc_id"], r["slot"], r["shard"]) for r in shards.shard_documents(docs(list(enumerate(texts)))).collect()}
    assert len(again) == len(texts)
    assert shards.shard_documents(docs([]).where("false")).count() == 0


def test_placing_balances_all_resources():
    v = np.random.default_rng(3).gamma(2, 100, (5000, 3))
    at = shards.place(v, 40)
    for k in range(3):
        load = np.bincount(at, weights=v[:, k], minlength=40)
        assert load.max() / load.mean() < (1.001 if k == 0 else 1.1)


def base_scan(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_license_places(docs):
    rng = random.Random(8)
    bits = ["cc", "by", "CC BY-NC 4.0", "all rights reserved.", "General Public License", "é", "x", "gnu", "(cc-by)", "All", "rights", "İ", "by\x00cc"]
    texts = [None, "", *(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(200)), "cc by " * 20_000]
    rows = licenses.scan_licenses(docs(texts).withColumn("detections", F.lit(1))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], sorted(r["base_labels"])) == base_scan(texts[r["doc_id"]])
    assert licenses.scan_licenses(docs([]).where("false")).count() == 0


def test_license_rules():
    s = licenses.Scanner()
    found = lambda t: [d["label"] for d in s.scan(t)["detections"]]
    assert found("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert found("SPDX-License-Identifier: MIT") == ["mit"] and found("Released under the MIT license.") == ["mit"]
    assert found("GPL v3 or later") == ["gpl-3"] and found("under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert found("GNU Lesser General Public License version 2.1") == ["lgpl-2.1"]
    assert found("ich gehe mit dem Hund. Copyright laws are old.") == [] and found("the apache people") == []
    assert all(r.gate for r in s.rules) and len(s.rules) > 300
    # Every rule's gate is part of what it matches, so the gate loses nothing.
    assert all(w in r.pattern.pattern for r in s.rules for w in r.gate)
    # Inside a span of an earlier rank: gone; beside it: kept; longer first in equal rank.
    assert licenses.resolve([(2, 0, 10, 1), (3, 2, 8, 2), (3, 2, 12, 3), (2, 4, 6, 4)]) == [(2, 0, 10, 1), (3, 2, 12, 3)]


@needs_data
def test_language_by_held_out_rows(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(d, langid.fit_documents(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == d.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(docs, prose):
    rows = docs([(None, "abc"), (1, None), (2, ""), (3, "12 + 3!"), *((k, prose(k, 20)) for k in range(4, 30)), (31, "ab " * 200_000)]).withColumn("score", F.lit("x"))
    m = langid.fit_documents(rows)
    got = {r["doc_id"]: r for r in langid.identify(rows, m).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "en" and not got[None]["held_out"]
    none = langid.fit_documents(rows.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(rows, none).collect()} == {"und"}
    assert langid.identify(rows.where("false"), langid.fit_documents(rows.where("false"))).count() == 0


def test_long_texts_lose_no_grams():
    from pagetwin.llm import subwords

    t = "ab cdé" * 1000
    whole = np.sort(np.concatenate(list(subwords.word_grams(t, 1 << 15))))
    size, subwords.WINDOW = subwords.WINDOW, 97
    try:
        assert (np.sort(np.concatenate(list(subwords.word_grams(t, 1 << 15)))) == whole).all()
    finally:
        subwords.WINDOW = size


@needs_data
def test_quality_by_held_out_rows(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else DATA
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # Equal texts go to one side.
    half = d.withColumn("side", F.pmod(F.xxhash64("text"), F.lit(2)))
    m = quality.fit_documents(half.where("side = 0").drop("side"), labels, max_rows=1500)
    rows = quality.rate_documents(half.where("side = 1").drop("side"), m).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) >= 0.98 and np.mean([r["kept"] for r in bad]) <= 0.1
    assert all(0 <= r["expected_grade"] <= 1 for r in rows)


def test_ordinal_grades_and_edges(spark, docs):
    rng = random.Random(1)
    level = lambda k: " ".join(rng.choice(["junk!!", "***"] if k == 0 else ["plain", "words", "!!"] if k == 1 else ["fine", "prose", "here"]) for _ in range(30))
    texts, grades = zip(*((level(k), k) for k in [0, 1, 2] * 40))
    m = quality.fit(list(texts), list(grades))
    expected = [np.mean([m.rate(level(k), 2)[0] for _ in range(10)]) for k in range(3)]
    assert expected[0] < 0.5 < expected[1] < 1.5 < expected[2] and (np.diff(m.thresholds) >= 0).all()
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = docs([(1, "a"), (2, None), (3, " "), (None, "b")]).withColumn("kept", F.lit(1))
    one = quality.fit_documents(rows, labels)
    assert {(r["doc_id"], r["kept"]) for r in quality.rate_documents(rows, one).collect()} == {(1, True), (2, False), (3, False), (None, True)}
    assert sorted(r["doc_id"] or 0 for r in quality.drop_poor(rows, labels).collect()) == [0, 1] and quality.drop_poor(rows, labels).columns == rows.columns
    assert quality.rate_documents(rows.where("false"), quality.fit_documents(rows.where("false"), labels.where("false"))).count() == 0
