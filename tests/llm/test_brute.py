"""Samples, the two classifiers, placing, suppression and odd tables against plain loops."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetwin.llm import bpe, exact, fingerprints, langid, licenses, minhash, packing, quality, samples, shards, substrings

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def test_a_share_of_any_count():
    for n in (10, 1000, 10**6, 10**10, 10**13):
        assert abs(samples.share(n, 4000, 4) * n - min(n, 1000)) < 1e-6
    assert samples.share(5, 10, 100) * 5 == 1


def test_samples_keep_every_label(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") < 58_000, "a").when(F.col("id") < 59_990, "b").otherwise("c").alias("lang"))
    got = samples.labelled(rows, "lang", 900)
    n = {k: sum(r["lang"] == k for r in got) for k in "abc"}
    assert 220 < n["a"] < 380 and 220 < n["b"] < 380 and n["c"] == 10
    many = rows.withColumn("lang", F.col("doc_id").cast("string"))
    assert len(samples.labelled(many, "lang", 300)) == 300 and samples.labelled(rows.where("false"), "lang", 10) == []


def test_stretches_of_long_texts(spark):
    rows = [("ab" * 40,), ("short",), (None,), ("0123456789" * 30,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(samples.stretch(F.col("t"), 50)).collect()]
    assert got[1:3] == ["short", None] and all(len(g) == 50 and g in r[0] for g, r in zip(got, rows) if g and r[0] != "short")


def grams(text, sizes=(2, 3, 4)):
    """Letter n-grams of words with both ends marked by 0."""
    out = []
    for n in sizes:
        words = "".join(c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0")
        words = re.sub("\0+", "\0", words)
        out += [words[k : k + n] for k in range(len(words) - n + 1) if "\0" not in words[k + 1 : k + n - 1]]
    return out


def test_language_scores_are_means_over_grams():
    rng = np.random.default_rng(1)
    m = langid.Model(["x", "y", "z"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.0, -0.2]), temperature=0.7)
    for text in ("Hello, wörld 12 ab", "a", "x-y", "Straße 東京 und so"):
        total = np.zeros(3)
        found = grams(text)
        for g in found:
            acc = np.array([len(g) * 0x9E3779B1 & 0xFFFFFFFF], np.uint32)
            for c in g:
                acc = (acc ^ np.uint32(ord(c))) * np.uint32(0x85EBCA6B)
                acc ^= acc >> np.uint32(15)
            total += m.table[int(acc[0]) & langid.BUCKETS - 1].astype(np.float64)
        z = (total / len(found) + m.bias) / 0.7
        p = np.exp(z) / np.exp(z).sum()
        label, score = m.predict(text)
        assert label == m.labels[int(p.argmax())] and abs(score - p.max()) < 1e-9


def test_language_gradients():
    rng = np.random.default_rng(2)
    rows, f, w, b = rng.normal(size=(5, 4)), rng.dirichlet(np.ones(5)), rng.normal(size=(4, 3)), rng.normal(size=3)
    loss = lambda rows, w, b: -np.log(langid.softmax(f @ rows @ w + b)[1])
    for got, part, at in zip(langid.gradients(rows, f, w, b, 1), (w, b, rows), (1, 2, 0)):
        want = np.zeros_like(part)
        for k in np.ndindex(part.shape):
            up, down = part.copy(), part.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            args = lambda x: [x if i == at else y for i, y in enumerate((rows, w, b))]  # noqa: B023, E731
            want[k] = (loss(*args(up)) - loss(*args(down))) / 2e-6
        assert np.allclose(got, want, atol=1e-6)


def test_grade_slopes():
    theta = np.array([-0.7, 0.2, 1.3])
    assert abs(sum(quality.likelihood(0.4, theta, c) for c in range(4)) - 1) < 1e-12
    for c in range(4):
        score, marks = quality.slopes(0.4, theta, c)
        log = lambda z, t: np.log(quality.likelihood(z, t, c))  # noqa: B023, E731
        assert abs(score - (log(0.4 + 1e-6, theta) - log(0.4 - 1e-6, theta)) / 2e-6) < 1e-5
        for k in range(3):
            e = np.eye(3)[k] * 1e-6
            assert abs(marks[k] - (log(0.4, theta + e) - log(0.4, theta - e)) / 2e-6) < 1e-5


def test_ratings_by_a_plain_sum():
    m = quality.fit(["junk!! ***"] * 20 + ["plain words here"] * 20, [0] * 20 + [1] * 20)
    for t in ("plain words", "*** junk!!", "other"):
        at, x = quality.features(t)
        z = sum(m.weights[a] * v for a, v in zip(at.tolist(), x.tolist()))
        tail = 1 / (1 + np.exp(-(z - m.thresholds[0])))
        assert np.allclose(m.rate(t, 1), (tail, tail))


def placed(vectors, n):
    """Placing by a plain loop."""
    total = [sum(v[r] for v in vectors) / n or 1 for r in range(3)]
    need = [[v[r] / total[r] for r in range(3)] for v in vectors]
    left, out = [[1.0] * 3 for _ in range(n)], {}
    for k in sorted(range(len(need)), key=lambda k: -max(need[k])):
        fits = [s for s in range(n) if all(left[s][r] >= need[k][r] - 1e-12 for r in range(3))]
        at = max(fits, key=lambda s: sum(a * b for a, b in zip(left[s], need[k]))) if fits else max(range(n), key=lambda s: left[s][0])
        left[at] = [a - b for a, b in zip(left[at], need[k])]
        out[k] = at
    return [out[k] for k in range(len(need))]


def test_placing_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(shards, "level", lambda size, at, n: at)
    for seed in range(4):
        v = np.random.default_rng(seed).integers(1, 10_000, (300, 3)).astype(float)
        assert shards.place(v, 7).tolist() == placed(v.tolist(), 7)


def test_leveling_only_narrows():
    rng = np.random.default_rng(4)
    size, at = rng.integers(1, 5000, 600), rng.integers(0, 9, 600).astype(np.int32)
    spread = lambda a: np.ptp(np.bincount(a, weights=size, minlength=9))
    done = shards.level(size, at.copy(), 9)
    assert spread(done) <= 1 or spread(done) < 0.01 * spread(at)


def suppressed(found):
    """What stays, by looking at all pairs: nothing inside a kept span of an earlier or the same rank."""
    kept = []
    for f in sorted(found, key=lambda f: (f[0], f[1] - f[2], f[1], f[3])):
        if not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[1], f[2], f[3]))


def test_suppression_equals_all_pairs():
    rng = random.Random(9)
    for _ in range(500):
        found = []
        for k in range(rng.randint(0, 14)):
            a = rng.randint(0, 20)
            found.append((rng.randint(0, 3), a, a + rng.randint(1, 9), k))
        assert licenses.resolve(found) == suppressed(found)


def test_gates_lose_no_rule():
    s = licenses.Scanner()
    rng = random.Random(3)
    bits = ["released under the", "licensed under", "apache", "mit", "license", "version 2.0", "gpl", "v3", "or later", "cc by sa", "4 0", "bsd 3 clause", "public domain", "into the", "spdx license identifier", "all rights reserved", "some", "rights reserved", "copyright 2020", "x"]
    for _ in range(300):
        t = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        line = f" {' '.join(re.findall(r'[a-z0-9]+', t.lower()))} "
        found = [(r.priority, m.start(), m.end(), k) for k, r in enumerate(s.rules) for m in r.pattern.finditer(line)]
        assert [d["rule"] for d in s.scan(t)["detections"]] == [f[3] for f in suppressed(found)]


def test_special_tokens_as_the_library_finds_them(docs):
    t = Tokenizer.from_file(PLAIN)
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|>c", "<|endoftext", "plain"]
    rows = packing.pack_documents(docs(texts), PLAIN).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        (r,) = (r for r in rows if r["doc_id"] == i)
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert t.encode(texts[0], add_special_tokens=False).ids[1] == 50256


CLASHING = ["__id", "__cut", "__text", "__hash", "__sha", "__gone", "d", "doc", "cut", "left", "gone", "id", "hash", "sha", "rep", "root", "odd `name`"]


@pytest.mark.parametrize("stage", [exact.drop_exact, minhash.drop_near, substrings.cut_paragraphs])
def test_columns_of_any_name_stay(docs, prose, stage):
    p = prose(1, 60)
    rows = docs([(1, p), (2, p), (2, p), (3, f"{p} {prose(2, 90)}"), (None, None)])
    for k, c in enumerate(CLASHING):
        rows = rows.withColumn(c, F.lit(k))
    out = stage(rows)
    assert out.columns == rows.columns and all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in out.collect())


def test_repeated_rows_and_very_long_texts(docs, prose):
    long = prose(3, 50_000)
    rows = docs([(1, "cc by"), (1, "cc by"), (2, long), (2, long), (3, long + " x")])
    n = lambda df: sorted((r["doc_id"] for r in df.collect()))
    assert n(licenses.scan_licenses(rows)) == n(bpe.digest_documents(rows, MULTI, P.PATTERN)) == n(fingerprints.fingerprint_documents(rows)) == [1, 1, 2, 2, 3]
    packed = packing.pack_documents(rows, PLAIN).groupBy("doc_id", "piece").count().collect()
    assert {r["count"] for r in packed if r["doc_id"] in (1, 2)} == {2} and {r["count"] for r in packed if r["doc_id"] == 3} == {1}
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_groups(rows).collect()}
    assert groups == {(1, 1, 2), (2, 2, 2), (3, 3, 1)}
    assert {r["doc_id"]: r["text"] for r in substrings.cut_paragraphs(rows).collect()} == {1: "cc by", 2: long, 3: "x"}


def test_a_document_larger_than_a_shard(docs, prose):
    rows = shards.shard_documents(docs([prose(1, 30_000), *(prose(k, 30) for k in range(200))])).collect()
    big = next(r for r in rows if r["doc_id"] == 0)
    assert len(rows) == 201 and sum(r["shard"] == big["shard"] for r in rows) == 1
    for s in {r["shard"] for r in rows}:
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
